"""Sharding by k-d tree partitioning: near-equal bytes, equal texts together.

The unit is a group of rows with equal texts (by 64-bit hash and size). The few groups that weigh more
than 1/64 of a shard are placed first, and only one heavier than a whole shard is dealt into pieces.
The others have metadata dimensions scaled to 0..1; a node of the tree is split at the weighted median
of the dimension along which its groups spread widest (weighted by the room its shards have left), until
leaves have the target bytes. Medians come from histograms of
bytes, summed in Spark and refined bin by bin; ties inside a dimension are ordered by the text's hash,
so a cut falls between two groups and never depends on how many share a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.text import whole
from logloom.session import stored

SHARDS = 16
#: Bits of an order key: the dimension's value, then the hash that breaks its ties.
VALUE_BITS, TIE_BITS = 30, 32
#: Bits a refinement resolves; so many bins per node are collected.
STEP_BITS = 10
#: A cut is fine enough when what its bin holds is at most this share of a shard.
TOLERANCE = 0.0005
#: A text whose copies weigh more than this part of a shard is placed before the others.
HEAVY = 64
DIMENSIONS = ("size", "lang", "source", "key")


def _order_key(value: Column, tie: Column) -> Column:
    scaled = F.least(F.lit(2**VALUE_BITS - 1), F.floor(value * 2**VALUE_BITS).cast("long"))
    return F.shiftleft(scaled, TIE_BITS) + F.shiftrightunsigned(tie, 64 - TIE_BITS)


def _fraction(text: Column) -> Column:
    """A text's place among texts, by hash: names have no scale of their own."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(1 << 20)) / F.lit(float(1 << 20))


def _cuts(groups: DataFrame, nodes: list[dict], target: float) -> list[int]:
    """For each node (its filter, its order key and the bytes wanted below), the order key to cut at."""
    bits = VALUE_BITS + TIE_BITS
    low, below, shift, open_ = [0] * len(nodes), [0.0] * len(nodes), bits, list(range(len(nodes)))
    while open_ and shift > 0:
        shift = max(0, shift - STEP_BITS)
        picked = None
        for i in open_:
            span = 1 << min(bits, shift + STEP_BITS)
            inside = F.col("node") == nodes[i]["node"]
            key = F.col(nodes[i]["order"])
            within = (key >= low[i]) & (key < low[i] + span) if low[i] + span < 1 << 63 else key >= low[i]
            bin_ = F.when(inside & within, F.struct(F.lit(i).alias("i"), F.shiftright(key - F.lit(low[i]).cast("long"), shift).alias("bin")))
            picked = bin_ if picked is None else F.coalesce(picked, bin_)
        binned = groups.select(picked.alias("b"), "bytes").filter("b IS NOT NULL").groupBy("b.i", "b.bin").agg(F.sum("bytes").alias("bytes"))
        sums: dict[int, list] = {}
        for r in binned.collect():  # at most 2^STEP_BITS rows a node
            sums.setdefault(r["i"], []).append((r["bin"], r["bytes"]))
        still = []
        for i in open_:
            want = nodes[i]["want"]
            for bin_, size in sorted(sums.get(i, [])):
                if below[i] + size > want:
                    low[i] += bin_ << shift
                    # the whole bin goes to the nearer side once it is small or cannot be refined
                    if size > target * TOLERANCE and shift > 0:
                        still.append(i)
                    elif want - below[i] > below[i] + size - want:
                        low[i] += 1 << shift
                    break
                below[i] += size
            else:
                low[i] = (1 << 62) + (1 << 61)
        open_ = still
    return low


def _place_heavy(sizes: DataFrame, shards: int, target: float) -> list[tuple[int, int, int, int, int]]:
    """(hash, size, piece, pieces, shard) of the texts whose copies weigh much of a shard.

    Bytes add up to ``shards * target``, so there are at most ``shards * HEAVY`` of them. The heaviest goes
    first, each to the shard that is emptiest by then. Only a text heavier than a shard is dealt into pieces.
    """
    heavy = sizes.filter(F.col("bytes") > target / HEAVY).collect()
    pieces = []
    for r in heavy:
        n = 1 if r["bytes"] <= target else -(-int(4 * r["bytes"]) // max(1, int(target)))
        pieces += [(r["bytes"] / n, r["hash"], r["size"], k, n) for k in range(n)]
    load, placed = [0.0] * shards, []
    for size, *names in sorted(pieces, reverse=True):
        leaf = load.index(min(load))
        load[leaf] += size
        placed.append((*names, leaf))
    return placed


def _groups(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """(rows with their group, heavy groups with their shards, the other groups with bytes, dimensions and order keys, bytes of a shard)."""
    spark = rows.sparkSession
    sizes = stored(rows.groupBy("hash", "size").agg(F.sum("size").alias("bytes")), "texts")
    target = (sizes.agg(F.sum("bytes")).first()[0] or 0) / shards
    heavy = spark.createDataFrame(_place_heavy(sizes, shards, target), "hash long, size long, piece long, pieces long, shard int")
    hot = heavy.select("hash", "size", "pieces").distinct()
    dealt = rows.join(F.broadcast(hot), ["hash", "size"], "left")
    piece = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64(F.lit(1), "key"), F.col("pieces"))).otherwise(F.lit(0)).cast("long")
    dealt = dealt.withColumn("piece", piece)
    grouped = dealt.filter("pieces IS NULL").groupBy("hash", "size", "piece").agg(F.sum("size").alias("bytes"), F.min("lang").alias("lang"), F.min("source").alias("source"), F.min("key").alias("key"))
    grouped = stored(grouped, "groups")
    ends = grouped.agg(F.min(F.log1p("size")).alias("a"), F.max(F.log1p("size")).alias("b"), F.min("key").alias("c"), F.max("key").alias("d")).first()
    scale = lambda c, a, b: F.coalesce((c - F.lit(float(a or 0))) / F.lit(max(1e-9, float(b or 0) - float(a or 0))), F.lit(0.0))
    values = {
        "size": scale(F.log1p("size"), ends["a"], ends["b"]),
        "lang": _fraction(F.col("lang")),
        "source": _fraction(F.col("source")),
        "key": scale(F.col("key").cast("double"), ends["c"], ends["d"]),
    }
    tie = F.xxhash64("hash", "size", "piece")
    columns = [c for d in DIMENSIONS for c in (values[d].alias(d + "_value"), _order_key(values[d], tie).alias(d + "_order"))]
    tree_rows = stored(grouped.select("hash", "size", "piece", "bytes", F.lit(0).alias("node"), *columns), "tree")
    return dealt.drop("pieces"), heavy.drop("pieces"), tree_rows, target


def tree(groups: DataFrame, room: list[float], target: float) -> Column:
    """The leaf of every group as an expression over its order keys, so that leaf i gets bytes in proportion to ``room[i]``."""
    leaf = F.lit(0)
    level = {0: (0, len(room))}  # node -> first leaf, leaves
    current = groups
    while any(n > 1 for _, n in level.values()):
        extents = [F.struct(*(F.max(d + "_value") - F.min(d + "_value") for d in DIMENSIONS)).alias("e"), F.sum("bytes").alias("bytes")]
        seen = {r["node"]: r for r in current.groupBy("node").agg(*extents).collect()}  # at most one row a shard
        nodes = []
        for node, (first, n) in level.items():
            if n > 1:
                spread = list(seen[node]["e"]) if node in seen else [0.0] * len(DIMENSIONS)
                left, both = sum(room[first : first + n // 2]), sum(room[first : first + n])
                want = (seen[node]["bytes"] if node in seen else 0) * (left / both if both else 0.5)
                nodes.append({"node": node, "first": first, "n": n, "order": DIMENSIONS[spread.index(max(spread))] + "_order", "want": want})
        cuts = _cuts(current, nodes, target)
        following = {node: v for node, v in level.items() if v[1] == 1}
        moved = leaf
        for node, cut in zip(nodes, cuts, strict=True):
            half = node["n"] // 2
            following |= {node["first"]: (node["first"], half), node["first"] + half: (node["first"] + half, node["n"] - half)}
            moved = F.when((leaf == node["node"]) & (F.col(node["order"]) >= cut), F.lit(node["first"] + half)).otherwise(moved)
        leaf, level = moved, following
        if any(n > 1 for _, n in level.values()):
            current = stored(groups.withColumn("node", leaf), "tree")
    return leaf


def slots(rows: DataFrame) -> DataFrame:
    """``rows`` with ``slot``: gapless from 0 in each shard, ascending by key. No shard is gathered in one task."""
    ordered = rows.repartitionByRange("shard", "key", "hash").sortWithinPartitions("shard", "key", "hash")
    placed = stored(ordered.withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33)
    parts = placed.groupBy("shard", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("shard", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # one row per written part and shard in it
    joined = placed.withColumn("part", part).join(F.broadcast(starts), ["shard", "part"])
    return joined.withColumn("slot", F.col("at") - F.col("first") + F.col("start")).drop("at", "part", "first", "start")


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``. Null and empty texts have size 1 and are one group; repeated rows each take a
    slot; null keys and metadata have a place of their own; an empty table gives no rows; other columns
    are ignored.
    """
    t = whole(F.col(text))
    rows = docs.select(
        F.col(key).alias("key"),
        F.col(lang).cast("string").alias("lang"),
        F.col(source).cast("string").alias("source"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("crc"),
        F.xxhash64(t).alias("hash"),
    )
    rows = stored(rows, "sizes")
    dealt, heavy, groups, target = _groups(rows, shards)
    load = {r["shard"]: r["bytes"] for r in dealt.join(F.broadcast(heavy), ["hash", "size", "piece"]).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    room = [max(0.0, target - load.get(i, 0)) for i in range(shards)]
    leaves = groups.select("hash", "size", "piece", tree(groups, room, target).cast("int").alias("shard")).unionByName(heavy)
    placed = slots(dealt.join(stored(leaves, "leaves"), ["hash", "size", "piece"]).select("key", "size", "crc", "hash", "shard"))
    return placed.select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
