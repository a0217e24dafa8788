"""Whitening, fill-in-middle and chat formatting against plain versions."""

import hashlib
import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from logloom.llm import chat, middle, qd, whitening

from . import brute

FOLDERS = ("sf", "dirty", "empty")


def rows(spark, folder, name, *columns):
    result = entry.queries()[name](spark, folder)
    return [tuple(r) for r in (result.select(*columns) if columns else result).collect()]


def matrices():
    random = np.random.default_rng(1)
    left, right = (np.linalg.qr(random.standard_normal((60, 60)))[0] for _ in range(2))
    copied = random.standard_normal((80, 40))
    copied[:, 7], copied[:, 9] = copied[:, 3], 0
    return {
        "one column": random.standard_normal((9, 1)),
        "tall": random.standard_normal((114, 64)),
        "wide": random.standard_normal((10, 64)),
        "zero": np.zeros((5, 5)),
        "identity": np.eye(20),
        "low rank": random.standard_normal((100, 5)) @ random.standard_normal((5, 40)),
        "equal and near values": left @ np.diag(np.r_[np.ones(20) * 5, np.ones(20) * (1 + 1e-9), np.ones(20) * 1e-3]) @ right,
        "graded": left @ np.diag(10.0 ** -np.arange(60) / 3) @ right,
        "repeated column": copied,
        "wilkinson": np.diag(np.abs(np.arange(-10, 11.0))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1),
    }


@pytest.mark.parametrize("name", matrices())
def test_singular_vectors(name):
    m = matrices()[name]
    values, vectors = qd.right_singular(m)
    wanted = np.zeros(m.shape[1])
    found = np.linalg.svd(m, compute_uv=False)
    wanted[: len(found)] = found
    scale = max(wanted[0], 1e-300)
    assert np.abs(values - wanted).max() <= 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(m.shape[1])).max() < 1e-11
    assert np.abs(m.T @ (m @ vectors) - vectors * values**2).max() <= 1e-13 * scale**2


def test_small_singular_values_keep_their_digits():
    a, b = np.array([1.0, 1e-3, 1e-6, 1e-9]), np.array([0.5, 2e-4, 3e-7])
    product = np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False)
    values = np.sqrt(qd.dqds((a * a).tolist(), (b * b).tolist()))
    assert np.allclose(values[:2], product[:2], rtol=1e-12)
    assert math.isclose(float(np.prod(values)), float(np.prod(a)), rel_tol=1e-13)  # the determinant


def whitened(vectors: list[tuple], components: int = 16) -> dict:
    """(key, place) -> deviation, whitened, explained, from all rows in one process."""
    usable = [(k, [math.floor(64.0 * c) + 1_000_000 for c in v]) for k, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = Counter(len(x) for x in {tuple(x) for _, x in usable})
    if not sizes:
        return {}
    dim = max(sizes, key=lambda d: (sizes[d], d))
    usable = [(k, x) for k, x in usable if len(x) == dim]
    fit = np.array(sorted({tuple(x) for _, x in usable}), dtype=float)
    n, sums = len(fit), [sum(int(r[j]) for r in fit) for j in range(dim)]
    centred = fit - fit.mean(axis=0)
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    order = [i for i in np.argsort(-values) if values[i] > 1e-18 * max(values.max(), 1e-300) and values.max() > 0 and values[i] > values.max() * 1e-14][:components]
    made = {}
    for place, (k, x) in enumerate(usable):
        w = (np.array(x) - fit.mean(axis=0)) @ directions[:, order] / np.sqrt(values[order])
        made[k, place] = (n, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), w, values[order] / values.sum())
    return made


@pytest.mark.parametrize("name", FOLDERS)
def test_whitening(spark, folders, name):
    vectors = [(r["vec_id"], r["embedding"]) for r in brute.table(folders[name], "embeddings")]
    theirs = whitened(vectors)
    found = rows(spark, folders[name], "op11_embedding_whitening")
    width = len(next(iter(theirs.values()))[2]) if theirs else 0
    assert Counter(r[0] for r in found) == Counter(k for k, _ in theirs for _ in range(width))
    signs, by_key = {}, {}
    for (k, _), t in theirs.items():
        by_key.setdefault(k, []).append(t)
    for r in found:
        assert 0 <= r[6] < 1e-9
        fits = []
        for n, deviation, w, explained in by_key[r[0]]:
            if (r[2], r[3]) == (n, deviation):
                fits.append(w[r[1] - 1])
                assert math.isclose(r[5], explained[r[1] - 1], rel_tol=1e-6)
        assert any(math.isclose(abs(r[4]), abs(f), rel_tol=1e-6, abs_tol=1e-7) for f in fits)
        for f in fits:
            if len(fits) == 1 and abs(f) > 1e-3:
                assert signs.setdefault(r[1], np.sign(f * r[4])) == np.sign(f * r[4])


def test_whitening_of_wide_and_huge_numbers(spark):
    data = [(1, [1e9, 1.0]), (2, [-1e9, 2.0]), (3, [3e4, 5.0]), (4, [1e300, 0.0]), (5, [0.5, -0.5]), (6, [0.5, -0.5])]
    made = whitening.whiten(spark.createDataFrame(data, "vec_id bigint, embedding array<double>")).collect()
    assert Counter(r["vec_id"] for r in made) == {k: 2 for k in (1, 2, 3, 5, 6)} and {r["n"] for r in made} == {4}
    x = {k: [math.floor(64 * c) + 10**6 for c in v] for k, v in data if k not in (4, 6)}
    sums = [sum(v[j] for v in x.values()) for j in (0, 1)]
    exact = {k: sum((4 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for k, v in x.items()}
    assert all(r["deviation"] == (exact[5 if r["vec_id"] == 6 else r["vec_id"]] if exact[5 if r["vec_id"] == 6 else r["vec_id"]] < 2**63 else None) for r in made)
    assert max(r["identity_error"] for r in made) < 1e-9


def test_factors_are_merged_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "DRIVER_BYTES", 8 * 9)
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    data = [(i, [math.sin(i * j) * 9 for j in (1, 2, 3)]) for i in range(200)]
    many = whitening.stored(whitening.distinct_vectors(spark.createDataFrame(data, "vec_id bigint, v array<double>"), "v").repartition(7), "test")
    n, sums = many.count(), whitening.exact_sums(many, 3)
    factor = whitening.triangular_factor(many, 3, n, sums)
    x = np.floor(64 * np.array([v for _, v in data]))
    x = np.unique(x, axis=0)
    assert len(x) == n and np.allclose(factor.T @ factor, (x - x.mean(0)).T @ (x - x.mean(0)))


def middles(docs):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for d in docs:
        t, digest = d["text"] or "", sha(f"1:{'' if d['doc_id'] is None else d['doc_id']}")
        h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
        a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
        form = "plain" if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        output = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[form]
        yield d["doc_id"], len(t), form, *((None, None) if form == "plain" else (a, b - a)), sha(output), sha(t)


@pytest.mark.parametrize("name", FOLDERS)
def test_fill_in_middle(spark, folders, name):
    found = rows(spark, folders[name], "op12_fill_in_middle")
    assert Counter(found) == Counter(middles(brute.table(folders[name], "documents")))


def test_marked_texts_stay_plain(spark):
    texts = [(i, t) for i, t in enumerate(["a<P>b", "<M>", "<S", "<P", "a <s> b", "P>x", "<<P>>"] * 20)]
    made = middle.fill_in_middle(spark.createDataFrame(texts, "doc_id bigint, text string"))
    for r in made.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect():
        assert r["back"] == texts[r["doc_id"]][1]
        assert r["form"] == "plain" or not any(m in r["back"] for m in ("<P>", "<M>", "<S>"))


def test_wavelet_ranks_are_counts():
    symbols = np.random.default_rng(3).integers(0, 16, 1000).astype(np.uint8)
    matrix = middle.WaveletMatrix(symbols)
    at = np.array([0, 1, 63, 64, 65, 128, 999, 1000])
    for s in range(16):
        assert matrix.rank(s, at).tolist() == [int((symbols[:a] == s).sum()) for a in at]


@pytest.mark.parametrize(
    ("unit", "text", "ends"),
    [
        ("word", "one, two  three!", [0, 3, 8, 16]),
        ("word", "...", [0, 3]),
        ("line", "a\n\nb", [0, 2, 3, 4]),
        ("line", "a\nb\n", [0, 2, 4]),
        ("character", "é\U0001f600x", [0, 1, 2, 3]),
        ("line", "", [0]),
    ],
)
def test_units(unit, text, ends):
    classes = middle.Classes()
    texts = ["other words\nhere ", text, "\nmore"]  # neighbours in the same matrix
    for k in range(len(ends)):
        units, a, b = middle.cuts(texts, np.full(3, k), np.full(3, len(ends) - 1), unit, classes)
        assert (units[1], a[1], b[1]) == (len(ends) - 1, ends[k], ends[-1])


def test_a_text_longer_than_a_matrix(spark, monkeypatch):
    monkeypatch.setattr(middle, "MATRIX_CHARS", 10)
    texts = ["short", "x" * 25, "", "y z", "w" * 9]
    assert list(middle._grouped(texts)) == [(0, 1), (1, 2), (2, 4), (4, 5)]
    assert list(middle._grouped([])) == []


def chats(turns):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    held: dict = {}
    for t in turns:
        held.setdefault(t["conv_id"], []).append(t)
    lowest = lambda v: (v is not None, v if v is not None else 0)
    for key, all_ in held.items():
        all_.sort(key=lambda t: (lowest(t["turn"]), t["role"] is not None, t["role"] or "", t["text"] or ""))
        loss = "".join(t["text"] or "" for t in all_ if t["role"] == "assistant")
        yield key, len(all_), sha("".join(f"{t['role'] or ''}\n{t['text'] or ''}\n" for t in all_)), len(loss), sha(loss)


@pytest.mark.parametrize("name", FOLDERS)
def test_chat_formatting(spark, folders, name):
    turns = brute.table(folders[name], "conversations")
    turns += [{"conv_id": -7, "turn": i, "role": r, "text": "</s>[INST] ok [/INST]"} for i, r in enumerate(("user", "assistant"))]
    found = rows(spark, folders[name], "op13_chat_formatting")
    assert Counter(r[:5] for r in found) == Counter(chats(turns))
    assert all(r[5] >= r[3] for r in found)


RECORDS = {
    "messages": ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
    "conversations": ({"id": 3, "system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, [("system", "s"), ("user", "q"), ("assistant", "")]),
    "instruction": ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do"), ("user", "this"), ("assistant", "done")]),
    "prompt": ({"response": "r", "prompt": "p"}, [("user", "p"), ("assistant", "r")]),
    "completion": ({"prompt": "p", "completion": 12.5}, [("user", "p"), ("assistant", "12.5")]),
    "question": ({"question": "q", "answer": "a", "context": None}, [("user", "q"), ("assistant", "a")]),
    "nested": ({"data": {"prompt": "s", "messages": [{"role": "bot", "content": "hi"}]}}, [("system", "s"), ("assistant", "hi")]),
}


def test_layouts_are_told_by_their_paths(spark):
    data = [(name, json.dumps(record)) for name, (record, _) in RECORDS.items()]
    data += [("unknown", '{"a": {"b": [1, {"c": 2}]}}'), ("not json", "{"), ("null", None), ("list", "[1]"), ("more", '{"prompt": "p", "response": "r", "extra": 1}'), ("none", '{"messages": []}')]
    found = {r["key"]: r for r in chat.canonical_turns(spark.createDataFrame(data, "id string, record string"), key="id").collect()}
    assert len(found) == len(data)
    for name, (_, turns) in RECORDS.items():
        assert found[name]["layout"] == name and [tuple(t) for t in found[name]["turns"]] == turns
    for name in ("unknown", "not json", "null", "list", "more", "none"):
        assert found[name]["layout"] is None and found[name]["turns"] is None
    assert found["unknown"]["shape"] == "OBJECT<a: OBJECT<b: ARRAY<>>>" and found["not json"]["shape"] is None


def test_shape_of_declared_paths_is_that_of_records(spark):
    for record in ({"a": 1, "b": [{"c": 1.5, "d": [True]}]}, {"x": {"y": {"z": None}}}, {"l": [[{"k": "v"}]], "m": "2020"}):
        paths = {"a": ("a", "b[].c", "b[].d[]"), "x": ("x.y.z",), "l": ("l[][].k", "m")}[next(iter(record))]
        made = spark.range(1).select(chat.record_shape(F.parse_json(F.lit(json.dumps(record))))).first()[0]
        assert made == chat.shape(paths)


MEAN = ["</s>", "[INST]", "<\\/s>", "<\\\\/s>", "[\\INST]", "[ROLE]x[TEXT]", "<", "[", "\\", "", "a\n[/INST]", "</s></s>", "<</s>", "/s>", "INST]", "<s>", "é</s>"]


def test_texts_that_look_like_marks_come_back(spark):
    turns = [(str(i), [(role, a), ("assistant", b), ("assistant", ""), (role, b)]) for i, (a, b) in enumerate((a, b) for a in MEAN for b in MEAN) for role in ("user", "tool [TEXT]")]
    frame = spark.createDataFrame([(f"{i}-{n}", t) for n, (i, t) in enumerate(turns)], "key string, turns array<struct<role: string, text: string>>")
    template = chat.Template()
    made = chat.format_conversations(frame, template).select("key", template.read(chat.formatted_text(F.col("segments"))).alias("back"), chat.loss_text(F.col("segments"), template).alias("loss"))
    wanted = {f"{i}-{n}": t for n, (i, t) in enumerate(turns)}
    for r in made.collect():
        assert [tuple(t) for t in r["back"]] == wanted[r["key"]]
        assert r["loss"] == "".join(t for role, t in wanted[r["key"]] if role == "assistant")


def test_templates_that_could_be_mistaken_are_refused():
    for bad in ({"escape": "<"}, {"begin": "</s>"}, {"assistant_end": "s<"}, {"user": ("", "x")}):
        with pytest.raises(ValueError):
            chat.Template(**bad)
    with pytest.raises(ValueError):
        middle.Markers("<P>", "<P>", "<M>")
