"""Plain single-process versions of what the operators compute."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import xxhash
from tokenizers import Tokenizer


def table(folder: str, name: str) -> list[dict]:
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def tokenizer(name: str) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(name))


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def by_key(row: dict):
    return (row["doc_id"] is not None, row["doc_id"] or 0, row["text"] is not None, row["text"] or "")


def token_stream(docs: list[dict]) -> list[tuple]:
    model, start, rows = tokenizer("word_bpe_49k.json"), 0, []
    for d in sorted(docs, key=by_key):
        ids = [*model.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        rows.append((d["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    return rows


def pieces(docs: list[dict]) -> list[tuple]:
    model, rows = tokenizer("word_bpe_49k.json"), []
    for d in docs:
        ids = [*model.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        rows += [(d["doc_id"], n, at, len(ids[at : at + 4096]), crc(ids[at : at + 4096])) for n, at in enumerate(range(0, len(ids), 4096))]
    return rows


def token_counts(docs: list[dict]) -> list[tuple]:
    model = tokenizer("byte_bpe_50k.json")
    counts = [(d["doc_id"], len((d["text"] or "").encode()), len(model.encode(d["text"] or "", add_special_tokens=False).ids)) for d in docs]
    return [(*c, c[2] > 512) for c in counts]


def contamination(docs: list[dict], benchmark: list[dict]) -> list[tuple]:
    windows: dict[tuple, set] = {}
    for item in benchmark:
        w = words(item["text"])
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item["item_id"] is None else str(item["item_id"]))
    rows = []
    for d in docs:
        w, hit, items = words(d["text"]), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= found
        rows.append((d["doc_id"], len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return rows


def simhash(text: str) -> int:
    w = [x for x in re.split("[\x20\x09-\x0d]+", ascii_lower(text)) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(docs: list[dict], radius: int = 4) -> list[tuple]:
    prints = [simhash(d["text"]) for d in docs]
    parent = list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[top(i)] = top(j)
    least: dict[int, int] = {}
    order = lambda k: (k is not None, k or 0)
    for i, d in enumerate(docs):
        t = top(i)
        if t not in least or order(d["doc_id"]) < order(least[t]):
            least[t] = d["doc_id"]
    return [(d["doc_id"], f"{p:016x}", least[top(i)]) for i, (d, p) in enumerate(zip(docs, prints, strict=True))]


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def license_base(docs: list[dict]) -> list[tuple]:
    rows = []
    for d in docs:
        w = words(d["text"])
        found = [(i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in found]
        rows.append((d["doc_id"], len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))))
    return rows


def license_labels(docs: list[dict], templates, threshold: float = 0.8) -> list[tuple]:
    """doc_id and the labels of templates that a sentence or line contains, by comparing all pairs."""
    rows = []
    sets = [(label, set(words(text))) for label, text in templates]
    for d in docs:
        found, most = set(), 0.0
        for block in re.split(r"[.!?]+[ \t\r\f]+|\n+", d["text"] or ""):
            own = set(words(block))
            for label, template in sets:
                share = len(own & template) / len(template)
                if share >= threshold - 1e-9:
                    found.add(label)
                    most = max(most, share)
        rows.append((d["doc_id"], found, most))
    return rows


def edited(docs: list[dict]) -> list[tuple]:
    """doc_id, n_chars and the sha256 of the edited text; keys must differ."""
    ordered = sorted(docs, key=by_key)
    rows = []
    for i, d in enumerate(ordered):
        text, after = d["text"] or "", ordered[(i + 1) % len(ordered)]["text"] or ""
        half = len(text) // 2
        rows.append((d["doc_id"], len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    return rows
