import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.operators.chain import _runs, chain
from logloom.operators.quantiles import exact_quantiles
from logloom.operators.running import running_total
from logloom.operators.segments import flush_segments


def walk(points, step, start=None):
    anchors, free = [], start
    for x in sorted(set(points)):
        if free is None or x >= free:
            anchors.append(x)
            free = x + step
    return anchors


@pytest.mark.parametrize("step", [1, 7, 100, 5000])
@pytest.mark.parametrize("start", [None, 40])
def test_chain_equals_walk(spark, step, start):
    source = random.Random(step)
    groups = {g: [source.randrange(low, 20_000) for _ in range(n)] for g, n, low in [("hot", 4000, -5000), ("a", 30, 0), (None, 300, 0)]}
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    found = chain(spark.createDataFrame(rows, "g string, x long"), ["g"], "x", step, start, block_cells=3).collect()
    for g, xs in groups.items():
        assert sorted(row.anchor for row in found if row.g == g) == walk(xs, step, start)


@pytest.mark.parametrize("start", [None, 40])
@pytest.mark.parametrize("fan_in", [2, 3])
def test_a_tree_of_blocks_equals_walk(spark, start, fan_in):
    source = random.Random(fan_in)
    groups = {g: [source.randrange(low, 30_000) for _ in range(n)] for g, n, low in [("hot", 6000, -9000), ("gaps", 25, -9000), (None, 300, 0), ("one", 1, 0)]}
    rows = [(g, 1, x) for g, xs in groups.items() for x in xs for _ in range(1 + x % 2)] + [("nulls", 1, None)]
    found = chain(spark.createDataFrame(rows, "g string, _block int, x long"), ["g", "_block"], "x", 37, start, block_cells=3, fan_in=fan_in).collect()
    assert {tuple(r)[1] for r in found} == {1}
    for g, xs in groups.items():
        assert sorted(row.anchor for row in found if row.g == g) == walk(xs, 37, start)
    assert chain(spark.createDataFrame([], "g string, x long"), ["g"], "x", 5).collect() == []


def test_one_dense_key_is_spread_over_its_blocks(spark):
    points = spark.range(1_000_000).select(F.lit("hot").alias("g"), (F.col("id") * 3 + F.col("id") % 2).alias("x"))
    found = chain(points, ["g"], "x", 1000, block_cells=8, fan_in=16)
    anchors = sorted(r.anchor for r in found.collect())
    assert anchors == walk([i * 3 + i % 2 for i in range(1_000_000)], 1000)


def test_two_groups_of_one_hash_are_told_apart(spark):
    batch = pa.RecordBatch.from_pydict({"_run": [7, 7, 7, 8], "g": ["a", "a", "b", "b"], "_x": [1, 2, 1, 5]})
    assert [t["_x"].to_pylist() for t in _runs(iter([batch.slice(0, 1), batch.slice(1)]), ["g"])] == [[1, 2], [1], [5]]


def test_running_total(spark):
    source = random.Random(1)
    rows = [(source.choice("aab"), source.randrange(100), n, source.randrange(9)) for n in range(2000)]
    df = spark.createDataFrame(rows, "g string, t int, s int, v int")
    found = {r.s: r.running for r in running_total(df, ["g"], F.expr("t div 10"), ["t", "s"], F.col("v")).collect()}
    totals = {}
    for g, _, s, v in sorted(rows, key=lambda r: (r[1], r[2])):
        totals[g] = totals.get(g, 0) + v
        assert found[s] == totals[g]


def segments_of(rows, max_bytes):
    held, out = {}, {}
    for topic, at, seq, size in sorted(rows, key=lambda r: (r[1], r[2])):
        group = (topic, at // 3600)
        used, segment = held.get(group, (0, 0))
        if used >= max_bytes:
            used, segment = 0, segment + 1
        held[group] = (used + size, segment)
        out[seq] = segment
    return out


@pytest.mark.parametrize("max_bytes", [10, 30, 500, 100_000])
def test_segments_equal_a_buffer(spark, max_bytes):
    source = random.Random(max_bytes)
    rows = [(source.choice(["hot", "hot", "b", "c"]), source.randrange(9000), n, source.randrange(1, 60)) for n in range(3000)]
    lines = spark.createDataFrame(rows, "topic string, at int, seq int, bytes int").withColumn("ts", F.timestamp_seconds("at"))
    found = {r.seq: r.segment for r in flush_segments(lines, max_bytes=max_bytes).collect()}
    assert found == segments_of(rows, max_bytes)


def test_golden_flushes(spark):
    def run(sizes, max_bytes):
        rows = [("t", n, n, size) for n, size in enumerate(sizes)]
        lines = spark.createDataFrame(rows, "topic string, at int, seq int, bytes int").withColumn("ts", F.timestamp_seconds("at"))
        return [r.segment for r in flush_segments(lines, max_bytes=max_bytes).orderBy("seq").collect()]

    assert run([11, 11, 11, 5], 30) == [0, 0, 0, 1]
    assert run([10, 10], 10) == [0, 1]
    assert run([10, 10], 0) == [0, 0]


def test_exact_quantiles(spark):
    source = random.Random(4)
    rows = [(source.choice("hhh" + "ab"), round(source.expovariate(0.1), 3)) for _ in range(30_000)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for labels in (["g"], []):
        for row in exact_quantiles(df, "v", labels, (0.5, 0.9, 0.99), accuracy=200).collect():
            values = sorted(v for g, v in rows if v is not None and (not labels or g == row.g))
            assert row.n == len(values)
            for q, got in ((50, row.p50), (90, row.p90), (99, row.p99)):
                assert got == values[-(-q * len(values) // 100) - 1]
