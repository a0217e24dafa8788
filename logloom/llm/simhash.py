"""SimHash near-duplicates with BK-trees.

Fingerprints are made in Arrow batches; from then on only distinct fingerprints move. Two that differ
in at most ``radius`` bits agree on one of ``radius + 1`` blocks of bits, so each is sent to one shard
per block, keyed by the block's value. A shard larger than ``shard_size`` is cut again the same way
over its other bits (the same argument holds there), until none is: members of a shard differ, and so
few bits are left free in the end that there are no more values. Each shard builds a BK-tree,
children keyed by their Hamming distance to the parent, and every member follows only the edges within
the radius. A shard answers with one link per member to its smallest partner group, not with all
pairs; connected components over those links are the same as over all pairs.
"""

from __future__ import annotations


import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.components import components
from logloom.llm.text import keyed, whole
from logloom.session import stored

#: Fixed values of the fingerprint: words in a shingle and the hash seed.
SHINGLE_WORDS = 4
SEED = 42
#: Bits that linked fingerprints may differ in.
RADIUS = 4
#: Members from which a shard is cut again: no task holds more at once.
SHARD_SIZE = 2048
#: Members from which a shard's queries go down the tree together.
TOGETHER = 48
_WEIGHTS = (1 << np.arange(64, dtype=np.uint64)).astype(np.uint64)


def fingerprint(text: str) -> int:
    """The 64-bit SimHash of a text as an unsigned number; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = SHINGLE_WORDS - 1
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[:-last].tolist(), ends[last:].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(_WEIGHTS[2 * ones > len(hashes)].sum())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, simhash (the fingerprint's bits as a signed long) and text_hash of every row; null texts have no words."""

    def run(batches):
        for batch in batches:
            made = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made.view(np.int64))], ["k", "x", "f"])

    narrow = docs.select(F.col(key).alias("k"), whole(F.col(text)).alias("t"), F.xxhash64(whole(F.col(text))).alias("x"))
    kind = narrow.schema["k"].dataType.simpleString()
    made = narrow.mapInArrow(run, f"k {kind}, x bigint, f bigint")
    return made.select(F.col("k").alias(key), F.col("f").alias("simhash"), F.col("x").alias("text_hash"))


class BkTree:
    """Numbers by Hamming distance. Children of a node are kept by their distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        if len(self.values) == 1:
            return
        at = 0
        while True:
            distance = (self.values[at] ^ value).bit_count()
            child = self.children[at].get(distance)
            if child is None:
                self.children[at][distance] = len(self.values) - 1
                return
            at = child

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the members at most ``radius`` bits away."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            for edge, child in self.children[at].items():
                if -radius <= edge - distance <= radius:
                    todo.append(child)
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(member, smallest member of its group) for the groups that links within the shard make. ``values`` ascend."""
    if len(values) >= TOGETHER:
        return _links_together(values, radius)
    tree, parent = BkTree(), list(range(len(values)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):  # among those before it, so each pair is met once
        for j in tree.within(value, radius):
            a, b = top(i), top(j)
            parent[max(a, b)] = min(a, b)
        tree.add(value)
    return [(values[i], values[r]) for i in range(len(values)) if (r := top(i)) != i]


def _links_together(values: list[int], radius: int) -> list[tuple[int, int]]:
    """The same, with all members going down the tree at once: of each node those that follow an edge to it."""
    tree = BkTree()
    for value in values:
        tree.add(value)
    members = np.array(values, dtype=np.uint64)
    group = np.arange(len(values))
    todo = [(0, group)]
    while todo:
        at, asking = todo.pop()
        distance = np.bitwise_count(members[asking] ^ members[at]).astype(np.int64)
        found = asking[distance <= radius]
        if len(found):
            groups = group[found]
            least = min(groups.min(), group[at])
            if groups.max() != least or group[at] != least:
                group[np.isin(group, np.append(groups, group[at]))] = least
        for edge, child in tree.children[at].items():
            near = np.abs(distance - edge) <= radius
            if near.any():
                todo.append((child, asking[near]))
    return [(values[i], values[g]) for i, g in enumerate(group.tolist()) if g != i]


@functools.cache
def _cut_masks(fixed: int, radius: int) -> list[int]:
    """The bits that are fixed after one more block of the free ones is, for each block."""
    free = [b for b in range(64) if not fixed >> b & 1]
    ends = [round(k * len(free) / (radius + 1)) for k in range(radius + 2)]
    return [fixed | sum(1 << b for b in free[a:e]) for a, e in zip(ends[:-1], ends[1:], strict=True)]


def _cut(rows: DataFrame, radius: int) -> DataFrame:
    """mask, fixed, simhash: each member once per block of its shard's free bits."""

    def run(batches):
        for batch in batches:
            masks, values = (batch.column(c).to_numpy().view(np.uint64) for c in (0, 1))
            for mask in np.unique(masks).tolist():
                own = values[masks == mask]
                for wider in _cut_masks(mask, radius):
                    made = [np.full(len(own), wider, dtype=np.uint64), own & np.uint64(wider), own]
                    yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)) for m in made], ["mask", "fixed", "simhash"])

    return rows.select("mask", "simhash").mapInArrow(run, "mask bigint, fixed bigint, simhash bigint")


def _sharded(distinct: DataFrame, radius: int, shard_size: int) -> DataFrame:
    """mask (the bits all members of a shard share), fixed (their values), simhash: one row per member and shard.

    No shard has more than ``shard_size`` members, or 4 ** (radius + 1) if that is more: one with so few free
    bits is not cut, nor could it hold more.
    """
    least_free = max(2 * (radius + 1), shard_size.bit_length() - 1)
    done, level = None, distinct.select(F.lit(0).cast("long").alias("mask"), "simhash")
    while True:
        spread = stored(_cut(level, radius), "shards")
        sizes = spread.groupBy("mask", "fixed").agg(F.count("*").alias("n"))
        large = sizes.filter((F.col("n") > shard_size) & (64 - F.bit_count("mask") > least_free)).select("mask", "fixed")
        large = stored(large, "large")
        if large.isEmpty():
            return spread if done is None else done.unionByName(spread)
        small = spread.join(large, ["mask", "fixed"], "left_anti").select("mask", "fixed", "simhash")
        done = small if done is None else done.unionByName(small)
        level = spread.join(large, ["mask", "fixed"], "left_semi")


def links(distinct: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """u, v: links between distinct fingerprints whose components are those of all links."""
    shards = _sharded(distinct, radius, shard_size).withColumn("shard", F.xxhash64("mask", "fixed"))
    # a shard of one member has no link; sorted by shard, a task reads one shard after the other
    ordered = shards.select("shard", "mask", "fixed", "simhash").repartition("shard").sortWithinPartitions("shard", "mask", "fixed", "simhash")

    def run(batches):
        for table in keyed(batches, "shard"):
            if table.num_rows < 2:
                continue
            kinds: dict[tuple, list[int]] = {}  # two shards may share a hash
            for mask, fixed, value in zip(table["mask"].to_pylist(), table["fixed"].to_pylist(), table["simhash"].to_pylist(), strict=True):
                kinds.setdefault((mask, fixed), []).append(value & 0xFFFFFFFFFFFFFFFF)
            found = [pair for values in kinds.values() for pair in shard_links(sorted(values), radius)]
            if found:
                pairs = np.array(found, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    return ordered.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, fingerprint, component_id (the smallest key reachable over links), simhash, text_hash, kept.

    ``kept`` marks, on each row, whether its key and text are the ones its component keeps. Texts
    without words share the fingerprint zero and link like others. Null keys rank before all others
    and are the component's id where they occur. An empty table gives no rows.
    """
    made = stored(fingerprints(docs, key, text), "fingerprints")
    distinct = made.select("simhash").distinct()
    roots = components(links(distinct, radius))
    rooted = made.join(roots, made["simhash"] == roots["u"], "left").select(made["*"], F.coalesce("root", "simhash").alias("root"))
    rooted = stored(rooted, "rooted")
    # a struct orders nulls first; one small row per component and task reaches the shuffle
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col(key).alias("k"), F.col("text_hash").alias("x"))).alias("first"))
    # stored, so that the join reads two plain tables and Spark can split a root with very many rows
    joined = rooted.join(stored(first, "first"), "root")
    return joined.select(
        key,
        F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"),
        F.col("first.k").alias("component_id"),
        "simhash",
        "text_hash",
        (F.struct(F.col(key).alias("k"), F.col("text_hash").alias("x")) == F.col("first")).alias("kept"),
    )


def deduplicate(docs: DataFrame, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the smallest key, then the smallest text hash."""
    # as a struct a null key equals itself, so one partitioning of the texts serves the join and the last step
    identity = F.struct(F.struct(F.col(key).alias("k")).alias("k"), F.col("text_hash").alias("x")).alias("__id")
    chosen = stored(near_duplicates(docs, radius, key, text).filter("kept").select(identity).distinct(), "chosen")
    own = F.struct(F.struct(F.col(key).alias("k")).alias("k"), F.xxhash64(whole(F.col(text))).alias("x"))
    return docs.withColumn("__id", own).join(chosen, "__id", "left_semi").dropDuplicates(["__id"]).select(*docs.columns)
