"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed once, in Arrow batches, and stored. The trees are grown on a
bounded sample of labelled rows (the sample with the smallest key hashes, at most ``TRAIN_ROWS`` rows);
every tree is complete, so a model is three arrays and scoring is ``DEPTH`` vectorised steps per tree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.text import whole
from logloom.session import stored

#: The documented bound of the training sample.
TRAIN_ROWS = 20_000
#: Growth of the trees.
TREES, DEPTH, BINS, RATE, L2, LEAST_ROWS = 60, 4, 64, 0.15, 1.0, 20
THRESHOLD = 0.3
#: Names of the statistics, in column order.
STATISTICS = (
    "log_bytes", "log_words", "log_lines", "mean_word", "spread_word", "longest_word", "upper", "lower", "digit", "space", "non_ascii", "punctuation",
    "symbol", "bar", "exclaim", "top_byte", "distinct_words", "top_word", "repeated_lines", "mean_line", "ends_symbol", "capital_words", "short_words", "word_entropy",
)
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(97, 123)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[128:] = 5
_CLASS[[ord(c) for c in ".,;:'\"?()-"]] = 6
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 7
_CLASS[ord("|")] = 8
_CLASS[ord("!")] = 9
_SYMBOL_END = re.compile(rb"[#$%&*+<=>@^_~|!]+(?=\s|$)")
_CAPITALS = re.compile(rb"\b[A-Z]{2,}\b")


def statistics(text: str) -> list[float]:
    """The statistics of one whole text; all 0 for the empty text."""
    data = text.encode()
    words = data.split()
    if not words:
        return [float(np.log1p(len(data)))] + [0.0] * (len(STATISTICS) - 1)
    n = len(words)
    per_byte = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    share = np.bincount(_CLASS, weights=per_byte, minlength=10) / len(data)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    often = np.fromiter(counts.values(), dtype=np.float64, count=len(counts)) / n
    lines = [line for line in data.split(b"\n") if line]
    per_byte[[9, 10, 11, 12, 13, 32]] = 0
    return [
        float(np.log1p(len(data))), float(np.log1p(n)), float(np.log1p(len(lines))), float(sizes.mean()), float(sizes.std()), float(sizes.max()),
        *share[1:3], share[3], share[4], share[5], share[6], share[7], share[8], share[9],
        float(per_byte.max()) / len(data), len(counts) / n, float(often.max()), 1 - len(set(lines)) / max(1, len(lines)), len(data) / max(1, len(lines)),
        len(_SYMBOL_END.findall(data)) / n, len(_CAPITALS.findall(data)) / n, float((sizes <= 2).mean()), float(-(often * np.log(often)).sum()),
    ]


@dataclass
class Trees:
    """Complete trees in arrays: inner node i has children 2i+1 (at most the threshold) and 2i+2."""

    base: float
    feature: np.ndarray  # tree, inner node
    threshold: np.ndarray
    leaf: np.ndarray  # tree, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.log2(inner + 1))):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Grow trees level by level on histograms of binned statistics, by gradient and curvature of the log loss.

    One class alone, or no rows, gives that class's smoothed share as every score.
    """
    rows, width = x.shape if x.size else (0, len(STATISTICS))
    share = (y.sum() + 1) / (len(y) + 2)
    inner, base = 2**depth - 1, float(np.log(share / (1 - share)))
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if rows < 2 * LEAST_ROWS or y.min() == y.max():
        return Trees(base, feature, threshold, leaf)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    column = np.arange(width) * BINS
    total = np.full(rows, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(rows, dtype=np.int64)  # within its level
        for level in range(depth):
            nodes = 2**level
            cell = (node[:, None] * (width * BINS) + column + binned).ravel()
            size = nodes * width * BINS
            sums = [np.bincount(cell, np.repeat(v, width), size).reshape(nodes, width, BINS) for v in (g, h, np.ones(rows))]
            left = [np.cumsum(s, axis=2) for s in sums]
            whole_ = [c[:, :, -1:] for c in left]
            right = [w - c for w, c in zip(whole_, left, strict=True)]
            gain = left[0] ** 2 / (left[1] + L2) + right[0] ** 2 / (right[1] + L2) - whole_[0] ** 2 / (whole_[1] + L2)
            gain[(left[2] < LEAST_ROWS) | (right[2] < LEAST_ROWS)] = -1
            best = gain.reshape(nodes, -1).argmax(axis=1)
            f, b = best // BINS, best % BINS
            splits = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            first = nodes - 1
            feature[t, first : first + nodes] = f
            threshold[t, first : first + nodes] = [edges[i][j] if ok and j < len(edges[i]) else np.inf for i, j, ok in zip(f, b, splits, strict=True)]
            node = 2 * node + (x[np.arange(rows), f[node]] > threshold[t, first + node])
        sums = [np.bincount(node, v, inner + 1) for v in (g, h)]
        leaf[t] = -RATE * sums[0] / (sums[1] + L2)
        total += leaf[t][node]
    return Trees(base, feature, threshold, leaf)


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text_hash and x (the statistics) of every row; a null text is the empty text."""

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()], dtype=np.float32).reshape(-1, len(STATISTICS))
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["k", "h", "x"])

    narrow = docs.select(F.col(key).alias("k"), whole(F.col(text)).alias("t"), F.xxhash64(whole(F.col(text))).alias("h"))
    kind = narrow.schema["k"].dataType.simpleString()
    made = narrow.mapInArrow(run, f"k {kind}, h bigint, x array<float>")
    return made.select(F.col("k").alias(key), F.col("h").alias("text_hash"), "x")


def held_out(key: Column) -> Column:
    """Whether labels of this key may not be learnt from; a null key's are not."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def _labelled(labels: DataFrame, key: str, label: str) -> DataFrame:
    """lk and y of the labels that may be learnt from; null labels teach nothing."""
    return labels.select(F.col(key).alias("lk"), F.col(label).alias("y")).filter(F.col("y").isNotNull() & ~held_out(F.col("lk")))


def _thinned(joined: DataFrame, rows: int) -> tuple[DataFrame, Column]:
    """About the first ``rows`` rows by the order of their keys' hashes, a few more at most, and that order.

    Thinned before they are ordered: otherwise every partition would send up to ``rows`` rows to the driver.
    """
    place = F.pmod(F.xxhash64("lk"), F.lit(1 << 30))
    return joined.filter(place < int(min(1.0, 1.1 * rows / max(1, joined.count())) * (1 << 30))), place


def _fitted(sample: DataFrame, place: Column, rows: int) -> Trees:
    found = sample.orderBy(place, "lk", "y", "x").limit(rows).select("x", "y").collect()
    x = np.array([r["x"] for r in found], dtype=np.float32).reshape(-1, len(STATISTICS))
    return fit(x, np.array([1.0 if r["y"] > 0 else 0.0 for r in found]))


def train(known: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id", label: str = "quality") -> Trees:
    """Trees from the stored statistics of labelled rows that are not held out."""
    joined = known.join(_labelled(labels, key, label), known[key] == F.col("lk")).select("x", "y", "lk")
    return _fitted(*_thinned(stored(joined, "labelled"), rows), rows)


def train_on_texts(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text", label: str = "quality") -> Trees:
    """As ``train``, with statistics of the rows it learns from only; keys alone are joined to choose these."""
    labelled = _labelled(labels, key, label)
    keys = stored(docs.select(F.col(key).alias("k")).join(labelled, F.col("k") == F.col("lk")).select("lk", "y"), "labelled")
    thinned, place = _thinned(keys, rows)
    chosen = stored(thinned.orderBy(place, "lk", "y").limit(rows).select("lk").distinct(), "chosen")  # up to `rows` keys
    narrow = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    texts = narrow.join(F.broadcast(chosen), F.col("k") == F.col("lk"), "left_semi")
    known = document_statistics(texts, "k", "t")
    # all labels of these keys, for rows and labels may be repeated
    mine = labelled.join(F.broadcast(chosen), "lk", "left_semi")
    return _fitted(known.join(mine, F.col("k") == F.col("lk")).select("x", "y", "lk"), place, rows)


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: key, held_out, score, predicted, text_hash.

    Scores depend on the text alone. Empty and null texts get the score of zero statistics; repeated
    rows and null keys are scored like any others; without labels every score is 0.5; an empty table
    gives no rows; other columns are ignored.
    """
    known = stored(document_statistics(docs, key, text), "statistics")
    trees = docs.sparkSession.sparkContext.broadcast(train(known, labels, rows, key, label))

    def run(batches):
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(trees.value.score(x))], ["k", "h", "score"])

    kind = known.schema[key].dataType.simpleString()
    scored = known.select(F.col(key).alias("k"), "text_hash", "x").mapInArrow(run, f"k {kind}, h bigint, score double")
    return scored.select(
        F.col("k").alias(key), held_out(F.col("k")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.col("h").alias("text_hash")
    )


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``docs`` without the rows whose text the classifier rejects."""
    trees = docs.sparkSession.sparkContext.broadcast(train_on_texts(docs, labels, rows, key, text, label))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts], dtype=np.float32).reshape(-1, len(STATISTICS))
        return pd.Series(trees.value.score(x))

    # a score depends on the text alone: scoring again where the text is costs less than moving it to its score
    return docs.filter(score(whole(F.col(text))) >= threshold)
