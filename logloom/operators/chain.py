"""Greedy chains on an ordered axis: a[0] = first point >= start, a[i+1] = first point >= a[i] + step.

Rate-limit windows that open at a key's first hit, and archive flushes that happen once enough
bytes are buffered, are both such chains. A chain looks sequential, yet a stretch of the axis acts
on it as a monotone step function "position where the chain may continue -> position after the
stretch". Step functions compose, and composition is associative: so the axis is cut into blocks,
functions of neighbouring blocks are merged in a tree, entries are handed down the tree, and every
block then replays its own part of the chain. Blocks arrive as sorted streams of narrow rows; a task
holds the distinct points of one block or the functions of one node of the tree, however much of the
data a key has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.session import stored

_NONE = np.iinfo(np.int64).min


def chain(
    points: DataFrame, group: list[str], point: str, step: int, start: int | None = None, block_cells: int = 64, fan_in: int = 1024
) -> DataFrame:
    """``group`` columns and ``anchor`` for every link of every group's chain.

    ``point`` is a BIGINT column; null points are left out. Without ``start`` a chain begins at the first
    point of its group. One task holds the distinct points of one block, ``block_cells * step`` units of the
    axis, or the functions of ``fan_in`` neighbours.
    """
    width = step * block_cells
    names = [f"_g{n}" for n in range(len(group))]
    kinds = ", ".join(f"{n} {points.schema[g].dataType.simpleString()}" for n, g in zip(names, group, strict=True))
    narrow = points.filter(F.col(point).isNotNull()).select(*[F.col(g).alias(n) for n, g in zip(names, group, strict=True)], F.col(point).cast("long").alias("_x"))
    # copies of a point are folded before they move
    distinct = stored(narrow.withColumn("_block", cell("_x", width)).distinct(), "points")
    function = f"{kinds}, _block bigint, _first bigint, _exit bigint"
    levels = [stored(_streamed(distinct, names, ["_block"], ["_x"]).mapInArrow(_block_functions(names, step, width), function), "steps")]
    while _blocks_of_a_group(levels[-1], names) > fan_in:
        above = levels[-1].withColumn("_node", cell("_block", fan_in))
        levels.append(stored(_streamed(above, names, ["_node"], ["_block", "_first"]).mapInArrow(_merged_functions(names), function), "steps"))
    floor = _NONE if start is None else start
    entry = f"{kinds}, _block bigint, _entry bigint"
    top = levels.pop().withColumn("_entry", F.lit(None).cast("long"))
    entries = _streamed(top, names, [], ["_block", "_first"]).mapInArrow(_handed_down(names, names, floor), entry)
    while levels:  # what enters a node enters its first block; it is the row without a block
        below = levels.pop().withColumns({"_node": cell("_block", fan_in), "_entry": F.lit(None).cast("long")})
        given = entries.select(*names, F.lit(None).cast("long").alias("_block"), F.lit(None).cast("long").alias("_first"), F.lit(None).cast("long").alias("_exit"), F.col("_block").alias("_node"), "_entry")
        entries = _streamed(below.unionByName(given), names, ["_node"], ["_block", "_first"]).mapInArrow(_handed_down(names, [*names, "_node"], floor), entry)
    both = distinct.withColumn("_entry", F.lit(None).cast("long")).unionByName(entries.withColumn("_x", F.lit(None).cast("long")))
    links = _streamed(both, names, ["_block"], ["_x"]).mapInArrow(_links(names, step), f"{kinds}, anchor bigint")
    return links.select(*[F.col(n).alias(g) for n, g in zip(names, group, strict=True)], "anchor")


def cell(column: str, width: int) -> Column:
    """Index of the stretch of the axis a BIGINT column falls into, exact for any magnitude."""
    return F.expr(f"`{column}` div {width}L - IF(pmod(`{column}`, {width}L) != 0 AND `{column}` < 0, 1L, 0L)")


def _blocks_of_a_group(functions: DataFrame, names: list[str]) -> int:
    """The most blocks a group has."""
    blocks = functions.select(*names, "_block").distinct().groupBy(*names).count()
    return blocks.agg(F.max("count")).first()[0] or 0


def _streamed(rows: DataFrame, names: list[str], by: list[str], order: list[str]) -> DataFrame:
    """Rows of one (names, by) behind each other in one task, in ``order``, nulls first; ``_run`` tells where they change."""
    run = F.xxhash64(*names, *by) if names or by else F.lit(0).cast("long")
    keyed = rows.withColumn("_run", run)
    return keyed.repartition("_run").sortWithinPartitions("_run", *names, *by, *order)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table per value of ``keys`` from batches sorted by ``_run`` and keys."""

    def whole(held: list[pa.RecordBatch]) -> Iterator[pa.Table]:
        table = pa.Table.from_batches(held)
        first, last = ([table[k][i].as_py() for k in keys] for i in (0, table.num_rows - 1))
        if first == last:  # sorted, so all between are equal, too
            yield table
            return
        values = list(zip(*(table[k].to_pylist() for k in keys), strict=True))  # two keys of one hash
        starts = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
        yield from (table.slice(a, b - a) for a, b in zip(starts[:-1], starts[1:], strict=True))

    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = batch.column("_run").to_numpy()
        cuts = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and runs[a] != at:
                yield from whole(held)
                held = []
            held.append(batch.slice(a, b - a))
            at = runs[a]
    if held:
        yield from whole(held)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    """A BIGINT column; nulls as the smallest number."""
    return table[name].combine_chunks().fill_null(_NONE).to_numpy()


def _batch(table: pa.Table, names: list[str], **columns) -> pa.RecordBatch:
    """Columns beside the table's key values, which are those of its first row."""
    length = len(next(iter(columns.values())))
    made = {n: pa.repeat(table[n][0], length) for n in names} | {c: pa.array(v, pa.int64()) for c, v in columns.items()}
    return pa.RecordBatch.from_arrays(list(made.values()), list(made))


def _block_functions(names: list[str], step: int, width: int):
    """Per block: for each first link the chain could take here, where it may continue afterwards."""

    def run(batches):
        for table in _runs(batches, [*names, "_block"]):
            xs, block = _numbers(table, "_x"), table["_block"][0].as_py()
            following = np.searchsorted(xs, xs + step)
            reach = min(int(np.searchsorted(xs, block * width + step)) + 1, len(xs))
            last = np.arange(reach)
            while (following[last] < len(xs)).any():
                ahead = following[last]
                last = np.where(ahead < len(xs), ahead, last)
            firsts, ends = _outcomes(xs[:reach], xs[last] + step)
            yield _batch(table, names, _block=np.full(len(firsts), block), _first=firsts, _exit=ends)

    return run


def _outcomes(firsts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row per distinct outcome: the last first link that leads to it."""
    kept = np.append(ends[1:] != ends[:-1], True)
    return firsts[kept], ends[kept]


def _through(entries: np.ndarray, firsts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where a block sends entries; those behind all of its first links pass unchanged."""
    at = np.searchsorted(firsts, entries)
    return np.where(at < len(firsts), ends[np.minimum(at, len(firsts) - 1)], entries)


def _functions(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    blocks, firsts, ends = (_numbers(table, c) for c in ("_block", "_first", "_exit"))
    cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(blocks[a]), firsts[a:b], ends[a:b]


def _merged_functions(names: list[str]):
    """The functions of a node's blocks, one after the other, as one function."""

    def run(batches):
        for table in _runs(batches, [*names, "_node"]):
            firsts = ends = np.empty(0, dtype=np.int64)
            for _, more, exits in _functions(table):
                ends = _through(ends, more, exits)
                behind = more > firsts[-1] if len(firsts) else np.ones(len(more), dtype=bool)
                firsts, ends = _outcomes(np.concatenate([firsts, more[behind]]), np.concatenate([ends, exits[behind]]))
            yield _batch(table, names, _block=np.full(len(firsts), table["_node"][0].as_py()), _first=firsts, _exit=ends)

    return run


def _handed_down(names: list[str], keys: list[str], floor: int):
    """Entries of a node's blocks, from what enters the node (the row without a block) or else ``floor``."""

    def run(batches):
        for table in _runs(batches, keys):
            at, blocks, entries = floor, [], []
            given = _numbers(table, "_entry")
            for block, firsts, ends in _functions(table):
                if block == _NONE:
                    at = int(given[0])
                    continue
                blocks.append(block)
                entries.append(at)
                at = int(_through(np.array([at]), firsts, ends)[0])
            if blocks:
                yield _batch(table, names, _block=blocks, _entry=entries)

    return run


def _links(names: list[str], step: int):
    """Per block: the links the chain really takes, given where it enters (the row without a point)."""

    def run(batches):
        for table in _runs(batches, [*names, "_block"]):
            xs, entry = _numbers(table, "_x")[1:], _numbers(table, "_entry")[0]
            found, at = [], int(np.searchsorted(xs, entry))
            while at < len(xs):
                found.append(int(xs[at]))
                at = int(np.searchsorted(xs, xs[at] + step))
            if found:
                yield _batch(table, names, anchor=found)

    return run
