"""The pipeline and its stages against plain versions."""

from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from logloom.llm import decontaminate, fingerprints, packing, quality, simhash
from logloom.llm.components import components
from logloom.session import configure
from pyspark.sql import functions as F

from . import brute


def plain(spark, folder: str) -> list[tuple]:
    docs = brute.table(folder, "documents")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    frame = spark.read.parquet(f"{folder}/documents.parquet").withColumn("n", F.monotonically_increasing_id())
    good = Counter()
    for r in quality.score_quality(frame, labels).filter("predicted = 1").collect():
        good[(r["doc_id"], r["text_hash"])] += 1
    hashed = {r["n"]: r["h"] for r in frame.select("n", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = [r["n"] for r in frame.select("n").orderBy("n").collect()]
    rows = [d | {"h": hashed[n]} for d, n in zip(docs, order, strict=True)]
    rows = [d for d in rows if (d["doc_id"], d["h"]) in good]
    kept: dict = {}
    for d, (_, _, component) in zip(rows, brute.groups(rows), strict=True):
        if d["doc_id"] == component:
            kept.setdefault((component, d["h"]), d)
    rows = list(kept.values())
    hit = brute.contamination(rows, brute.table(folder, "benchmark"))
    return brute.pieces([d for d, h in zip(rows, hit, strict=True) if not h[5]])


@pytest.mark.parametrize("name", ["sf", "dirty", "empty"])
def test_pipeline(spark, folders, name):
    packed = entry.queries()["pipeline"](spark, folders[name]).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in packed) == Counter(plain(spark, folders[name]))
    filled = Counter()
    for r in packed:
        filled[r["sequence_id"]] += r["length"]
    assert not filled or max(filled.values()) <= 4096


def test_stages_keep_the_columns_of_documents(spark, folders):
    configure(spark)
    docs = spark.read.parquet(f"{folders['dirty']}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folders["dirty"]).columns == docs.columns


def test_shards_that_are_too_large_are_cut_again(spark):
    import random

    random.seed(5)
    base = [random.getrandbits(64) for _ in range(30)]
    values = sorted({b ^ sum(1 << random.randrange(64) for _ in range(random.randint(0, 3))) & (2**64 - 1) for b in base for _ in range(8)})
    signed = [(v - (1 << 64) if v >= 1 << 63 else v,) for v in values]
    distinct = spark.createDataFrame(signed, "simhash long")
    roots = {r["u"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in components(simhash.links(distinct, shard_size=3)).collect()}
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 4:
                parent[top(a)] = top(b)
    ours, theirs = {}, {}
    for v in values:
        ours.setdefault(roots.get(v, v), set()).add(v)
        theirs.setdefault(top(v), set()).add(v)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(7, 7), (500, 501)], "u long, v long")
    found = {r["u"]: r["root"] for r in components(links).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {501: 500}


def test_sketches_merge_and_estimate(spark):
    a, b = " ".join(f"w{i}" for i in range(4000)), " ".join(f"w{i}" for i in range(2000, 6000))
    rows = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    r = rows.select(
        fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"),
        fingerprints.containment(F.col("a"), F.col("b")).alias("c"),
        fingerprints.distinct_shingles(F.col("a")).alias("n"),
        fingerprints.merge(F.col("a"), F.col("b")).alias("m"),
    ).first()
    assert abs(r["r"] - 1 / 3) < 0.15 and abs(r["c"] - 0.5) < 0.2 and abs(r["n"] / 3996 - 1) < 0.3
    parts = spark.createDataFrame([("x",), ("x",)], "g string")
    both = rows.select(F.lit("x").alias("g"), F.col("a").alias("s")).unionByName(rows.select(F.lit("x").alias("g"), F.col("b").alias("s")))
    assert parts.count() == 2 and fingerprints.merged(both, ["g"], "s").first()["s"] == r["m"]


def test_spans_are_cut_out(spark, folders):
    docs = spark.read.parquet(f"{folders['dirty']}/documents.parquet")
    bench = spark.read.parquet(f"{folders['dirty']}/benchmark.parquet")
    cut = {r["doc_id"]: r["text"] for r in decontaminate.cut_spans(docs, bench).collect()}
    assert cut[11] == "start end" and cut[5] == " ".join(f"term{i}" for i in range(60)) and cut[18] == ""
    assert len(cut) == len({d["doc_id"] for d in brute.table(folders["dirty"], "documents")})


def test_packing_is_optimal_on_small_instances():
    import random

    def best(items, capacity):
        least = [len(items)]

        def go(i, bins):
            if len(bins) >= least[0]:
                return
            if i == len(items):
                least[0] = len(bins)
                return
            for room in {b for b in bins if b + items[i] <= capacity}:
                at = bins.index(room)
                bins[at] += items[i]
                go(i + 1, bins)
                bins[at] -= items[i]
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return least[0]

    random.seed(2)
    for _ in range(300):
        capacity = random.choice([7, 12, 30])
        items = sorted((random.randint(1, capacity) for _ in range(random.randint(0, 8))), reverse=True)
        counts = Counter(items)
        fixed, left = packing.reduce_counts(dict(counts), capacity)
        rest = [n for n, c in left.items() for _ in range(c)]
        assert sum(t for t, _ in fixed) + best(rest, capacity) == best(items, capacity)
        assert sum(t for t, _ in packing.pack_counts(dict(counts), capacity)) <= best(items, capacity) + 1
