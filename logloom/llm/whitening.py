"""Whitening of embeddings: principal directions from blockwise QR and a bidiagonal qd solver.

Entries become whole numbers. Every distinct vector counts once in the fit; its sums are exact. Tasks
centre their vectors and fold them block by block into one small triangular factor each, factors are
merged in a tree, and the last one, as wide as a vector is long, goes to the driver, where ``qd`` finds
singular values and directions. All rows are then projected where they are read; nothing is joined.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.qd import right_singular
from logloom.session import stored

#: Fixed values of the contract: an entry c becomes floor(SCALE * c) + SHIFT; so many components are given.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Vectors folded into a triangular factor at once, factors merged by one task, and bytes of factors the driver merges itself.
BLOCK_ROWS, FAN_IN, DRIVER_BYTES = 4096, 32, 32 << 20
#: Singular values below this share of the largest, times the dimension, are noise of the arithmetic.
RANK = 2.0**-46
#: Numbers beyond this are left out like infinite ones: they have no whole number in a long.
_LARGEST = 2.0**62


@dataclass(frozen=True)
class Whitening:
    """What a fit found: ``n`` distinct vectors, exact ``sums``, directions as columns, eigenvalues, their trace."""

    dim: int
    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of whole-number vectors less SHIFT, one column per component."""
        return self.centred(x) @ self.directions / np.sqrt(self.eigenvalues)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x less the mean, rounded once: the whole part of the mean is taken off in whole numbers."""
    base = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([float(Fraction(s % n, n)) for s in sums])
    return (x - base).astype(np.float64) - rest


def whole_numbers(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, whole numbers less SHIFT) of the usable vectors of a list array, per length.

    Not usable are nulls, empty vectors and those with an entry that is null, not finite or beyond a long.
    """
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    made = []
    for dim in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == dim)
        entries = values.reshape(-1, dim) if len(at) == len(lengths) else values[starts[at][:, None] + np.arange(dim)]
        with np.errstate(invalid="ignore", over="ignore"):
            scaled = np.floor(SCALE * entries)
            usable = (np.abs(scaled) < _LARGEST).all(axis=1)  # false for what is not a number
        made.append((at[usable], scaled[usable].astype(np.int64)))
    return made


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of whole numbers as bytes, each as narrow as its largest entry allows; equal rows give equal bytes."""
    most = np.abs(x).max(axis=1)
    width = np.select([most < 1 << 15, most < 1 << 31], [2, 4], 8)
    rows = np.empty(len(x), dtype=object)
    for w in (2, 4, 8):
        at = np.flatnonzero(width == w)
        data, step = x[at].astype(f"<i{w}").tobytes(), w * x.shape[1]
        rows[at] = [data[i * step : (i + 1) * step] for i in range(len(at))]
    return pa.array(rows.tolist(), pa.binary())


def _unpacked(rows: pa.Array, dim: int) -> np.ndarray:
    sizes = pc.binary_length(rows).to_numpy()
    found = np.empty((len(rows), dim), dtype=np.int64)
    for w in np.unique(sizes // dim).tolist():
        at = np.flatnonzero(sizes == w * dim)
        found[at] = np.frombuffer(b"".join(rows.take(pa.array(at)).to_pylist()), dtype=f"<i{w}").reshape(-1, dim)
    return found


def _blocks(batches, dim: int):
    """Arrays of up to BLOCK_ROWS unpacked vectors."""
    held, rows = [], 0
    for batch in batches:
        held.append(_unpacked(batch.column(0), dim))
        rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            yield np.concatenate(held)
            held, rows = [], 0
    if rows:
        yield np.concatenate(held)


def distinct_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """dim, x: every distinct usable vector as packed whole numbers. Copies are folded before the shuffle."""

    def run(batches):
        for batch in batches:
            for _, x in whole_numbers(batch.column(0)):
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], dtype=np.int32)), _packed(x)], ["dim", "x"])

    return rows.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "dim int, x binary").distinct()


def exact_sums(fit: DataFrame, dim: int) -> tuple[int, ...]:
    """Sums per dimension (of numbers less SHIFT), as high and low halves so that none overflows."""

    def run(batches):
        for x in _blocks(batches, dim):
            halves = [pa.array((x >> 32).sum(axis=0)), pa.array((x & 0xFFFFFFFF).sum(axis=0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), *halves], ["j", "high", "low"])

    parts = fit.select("x").mapInArrow(run, "j int, high bigint, low bigint")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    sums = {r["j"]: (int(r["high"]) << 32) + int(r["low"]) for r in parts.groupBy("j").agg(*wide).collect()}  # one row a dimension
    return tuple(sums.get(j, 0) for j in range(dim))


def triangular_factor(fit: DataFrame, dim: int, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """R of the centred vectors' QR factorisation: blocks in tasks, then a tree of at most FAN_IN factors a task."""

    def fold(blocks):
        factor = np.empty((0, dim))
        for block in blocks:
            factor = np.linalg.qr(np.concatenate([factor, block]), mode="r")
        return factor

    def emit(factor):
        if len(factor):
            yield pa.RecordBatch.from_arrays([pa.array([factor.tobytes()], pa.binary())], ["r"])

    def first(batches):
        yield from emit(fold(_centred(x, n, sums) for x in _blocks(batches, dim)))

    def merge(batches):
        yield from emit(fold(np.frombuffer(r).reshape(-1, dim) for batch in batches for r in batch.column(0).to_pylist()))

    factors = stored(fit.select("x").mapInArrow(first, "r binary"), "factors")
    count = factors.count()
    while count > max(1, DRIVER_BYTES // (8 * dim * dim)):
        factors = stored(factors.repartition(-(-count // FAN_IN)).mapInArrow(merge, "r binary"), "factors")
        before, count = count, factors.count()
        if count >= before:
            break
    return fold(np.frombuffer(r["r"]).reshape(-1, dim) for r in factors.collect())


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors; None without any. Vectors of other lengths than most are not used."""
    lengths = fit.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if lengths is None:
        return None
    dim, n = lengths["dim"], lengths["n"]
    chosen = fit.filter(F.col("dim") == dim)
    sums = exact_sums(chosen, dim)
    factor = triangular_factor(chosen, dim, n, sums)
    values, directions = right_singular(factor, components)
    kept = values > (values[0] if len(values) else 0.0) * dim * RANK
    return Whitening(dim, n, sums, directions[:, kept], values[kept] ** 2 / n, float((factor * factor).sum()) / n)


def identity_error(fit: DataFrame, whitening: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, over the fit list."""
    k = len(whitening.eigenvalues)
    shared = fit.sparkSession.sparkContext.broadcast(whitening)

    def run(batches):
        w = shared.value
        for x in _blocks(batches, w.dim):
            made = w.project(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k)), pa.array(np.concatenate([(made.T @ made).ravel(), made.sum(axis=0)]))], ["i", "s"])

    parts = fit.filter(F.col("dim") == whitening.dim).select("x").mapInArrow(run, "i bigint, s double")
    sums = np.zeros(k * k + k)
    for r in parts.groupBy("i").agg(F.sum("s").alias("s")).collect():  # components squared and a few
        sums[r["i"]] = r["s"]
    mean = sums[k * k :] / whitening.n
    return float(np.abs(sums[: k * k].reshape(k, k) / whitening.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; None where a long cannot hold it."""
    base = np.array([s // n for s in sums], dtype=np.int64)
    moved = x - base
    most = int(np.abs(moved).max(initial=0)) + 1
    if x.shape[1] * (n * most) ** 2 < 1 << 63:
        rest = np.array([s % n for s in sums], dtype=np.int64)
        return ((n * moved - rest) ** 2).sum(axis=1).tolist()
    rest = np.array([s % n for s in sums], dtype=object)
    exact = ((moved.astype(object) * n - rest) ** 2).sum(axis=1).tolist()
    return [e if e < 1 << 63 else None for e in exact]


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Left out are rows whose vector is null, empty, of another length than most distinct vectors, or holds
    an entry that is null, not finite or beyond a long (after scaling). Repeated rows and null keys get
    their rows each, but equal vectors count once in the fit. Components whose eigenvalue is zero as far
    as double precision can tell have no whitening and are left out, so a table of one distinct vector
    gives no rows, nor does an empty one. ``deviation`` is null where a long cannot hold it. Other
    columns are ignored.
    """
    kind = rows.schema[key].dataType.simpleString()
    out = f"k {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fit = stored(distinct_vectors(rows, vector), "vectors")
    whitening = fit_whitening(fit, components)
    named = [F.col("k").alias(key), "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if whitening is None or not len(whitening.eigenvalues):
        return rows.sparkSession.createDataFrame([], out).select(*named)
    error = identity_error(fit, whitening)
    shared = rows.sparkSession.sparkContext.broadcast(whitening)

    def run(batches):
        w = shared.value
        k = len(w.eigenvalues)
        for batch in batches:
            for at, x in whole_numbers(batch.column(1)):
                if x.shape[1] != w.dim or not len(at):
                    continue
                rows_of = pa.array(np.repeat(at, k))
                columns = [
                    batch.column(0).take(rows_of),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(at) * k, w.n, dtype=np.int64)),
                    pa.array(deviations(x, w.n, w.sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                    pa.array(w.project(x).ravel()),
                    pa.array(np.tile(w.eigenvalues / w.trace, len(at))),
                    pa.array(np.full(len(at) * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["k", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, out).select(*named)
