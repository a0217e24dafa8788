"""The registered queries against plain versions, on test data, dirty tables and empty tables."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import compare
from logloom.llm import license_scan, quality
from logloom.llm.quality import STATISTICS, statistics

from . import brute

FOLDERS = ("sf", "dirty", "empty")


def rows(spark, folder: str, name: str, *columns: str) -> list[tuple]:
    result = entry.queries()[name](spark, folder)
    return [tuple(r) for r in (result.select(*columns) if columns else result).collect()]


def same(ours, theirs) -> None:
    assert Counter(ours) == Counter(theirs)


@pytest.mark.parametrize("name", FOLDERS)
def test_token_files(spark, folders, name):
    theirs = brute.token_stream(brute.table(folders[name], "documents"))
    same(rows(spark, folders[name], "op1_token_files", "doc_id", "start", "n_tokens", "ids_crc32"), theirs)


@pytest.mark.parametrize("name", FOLDERS)
def test_quality(spark, folders, name):
    docs = brute.table(folders[name], "documents")
    found = rows(spark, folders[name], "op2_quality_classifier", "doc_id", "held_out", "score", "predicted")
    assert Counter(r[0] for r in found) == Counter(d["doc_id"] for d in docs)
    for key, held, score, predicted in found:
        assert held == (key is None or zlib.crc32(str(key).encode()) % 5 == 0)
        assert 0 <= score <= 1 and predicted == int(score >= 0.3)


@pytest.mark.parametrize("rows", [20_000, 50])
def test_quality_learns_alike_from_chosen_texts(spark, folders, rows):
    for folder in [*folders.values(), "/root/testdata/sf0.001"]:
        docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
        docs = docs.withColumns({"lk": F.lit("clash"), "y": F.lit(1)})
        one = quality.train(quality.document_statistics(docs), labels, rows)
        other = quality.train_on_texts(docs, labels, rows)
        assert one.base == other.base and all((getattr(one, f) == getattr(other, f)).all() for f in ("feature", "threshold", "leaf"))


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in brute.table(sf, "labels")}
    found = [(p, label[k]) for k, h, p in rows(spark, sf, "op2_quality_classifier", "doc_id", "held_out", "predicted") if h and k in label]
    assert len(found) > 50 and sum(p == y for p, y in found) / len(found) > 0.95


def test_statistics_of_odd_texts():
    for text in ("", " ", "\n\n", "a", "x" * 100_000, "\x00", "é" * 10):
        assert len(statistics(text)) == len(STATISTICS)


@pytest.mark.parametrize("name", FOLDERS)
def test_license_scan(spark, folders, name):
    docs = brute.table(folders[name], "documents")
    found = rows(spark, folders[name], "op3_license_scan")
    same([r[:6] for r in found], brute.license_base(docs))
    own = {(k, frozenset(s), m) for k, s, m in brute.license_labels(docs, license_scan.TEMPLATES)}
    base = {(r[0], frozenset(filter(None, r[5].split(",")))) for r in found}
    for r in found:
        wanted = {frozenset(s | b) for k, s, _ in own if k == r[0] for kb, b in base if kb == k}
        assert frozenset(filter(None, r[6].split(","))) in wanted
        assert r[7] == 1.0 if r[2] else any(abs(r[7] - m) < 1e-9 for k, _, m in own if k == r[0])


@pytest.mark.parametrize("name", ("sf", "empty"))
def test_fingerprints(spark, folders, name):
    docs = brute.table(folders[name], "documents")
    found = rows(spark, folders[name], "op4_fingerprints")
    same([r[:3] for r in found], brute.edited(docs))
    text = {d["doc_id"]: d["text"] for d in docs}
    prints: dict = {}
    for r in found:
        assert prints.setdefault(text[r[0]], r[3]) == r[3]
        assert 0 <= r[5] <= 1 and 0 <= r[6] <= 1


def test_fingerprints_of_dirty_rows(spark, folders):
    docs = brute.table(folders["dirty"], "documents")
    found = rows(spark, folders["dirty"], "op4_fingerprints")
    assert Counter(r[0] for r in found) == Counter(d["doc_id"] for d in docs)
    unique = Counter(d["doc_id"] for d in docs)
    theirs = {r[0]: r for r in brute.edited([d for d in docs if d["doc_id"] not in (18, 19)])}
    checked = [r for r in found if r[0] in theirs and unique[r[0]] == 1 and r[0] != 17]
    assert len(checked) > 10 and all(r[:3] == theirs[r[0]] for r in checked)


@pytest.mark.parametrize("name", FOLDERS)
def test_packing(spark, folders, name):
    docs = brute.table(folders[name], "documents")
    found = rows(spark, folders[name], "op5_best_fit_packing", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    same([r[:5] for r in found], brute.pieces(docs))
    filled: dict = {}
    for r in sorted(found, key=lambda r: r[5:]):
        assert filled.get(r[5], 0) == r[6]
        filled[r[5]] = r[6] + r[3]
    assert all(n <= 4096 for n in filled.values())
    assert len(filled) <= -(-sum(r[3] for r in found) // 4096) + 1


EXTRACTED = {
    1: "Title & more\n\nFirst para graph.\n\nSecond one.",
    2: "Text of the second page.",
    3: "Text of the third page, which is long enough.",
    4: "unclosed markup\n\nand <more> é",
    5: "no url",
    6: "",
    7: "",
    None: "plain text only",
}


def test_extraction(spark, folders):
    found = rows(spark, folders["dirty"], "op6_html_extraction", "page_id", "text", "n_chars")
    assert Counter(r[0] for r in found) == Counter(p["page_id"] for p in brute.table(folders["dirty"], "pages"))
    assert all(EXTRACTED[k] == t for k, t, _ in found if k in EXTRACTED)
    assert all(len(t) == n for _, t, n in found)
    assert rows(spark, folders["empty"], "op6_html_extraction") == []


@pytest.mark.parametrize("name", FOLDERS)
def test_simhash_groups(spark, folders, name):
    same(rows(spark, folders[name], "op7_simhash_groups"), brute.groups(brute.table(folders[name], "documents")))


@pytest.mark.parametrize("name", FOLDERS)
def test_decontamination(spark, folders, name):
    theirs = brute.contamination(brute.table(folders[name], "documents"), brute.table(folders[name], "benchmark"))
    same(rows(spark, folders[name], "op8_decontamination"), theirs)


def test_decontamination_equals_sql(spark):
    assert compare(spark, "/root/testdata/sf0.001", "op8_decontamination") is None


@pytest.mark.parametrize("name", FOLDERS)
def test_sharding(spark, folders, name):
    docs = brute.table(folders[name], "documents")
    found = rows(spark, folders[name], "op9_sharding")
    sizes = [(d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs]
    same([r[:3] for r in found], sizes)
    assert {r[3] for r in found} <= {"bytes"} and {r[6] for r in found} <= {None}
    slots: dict = {}
    for r in found:
        slots.setdefault(r[4], []).append(r[5])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))


def test_shards_are_near_equal_and_keep_copies(spark):
    found = rows(spark, "/root/testdata/sf0.01", "op9_sharding")
    total: dict = {}
    where: dict = {}
    for r in found:
        total[r[4]] = total.get(r[4], 0) + r[1]
        where.setdefault(r[1:3], set()).add(r[4])
    assert len(total) == 16 and max(total.values()) < 1.15 * sum(total.values()) / 16
    assert all(len(s) == 1 for s in where.values())


@pytest.mark.parametrize("name", FOLDERS)
def test_token_counts(spark, folders, name):
    same(rows(spark, folders[name], "op10_token_counts"), brute.token_counts(brute.table(folders[name], "documents")))
