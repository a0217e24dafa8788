"""Pruned scans, broker options, hooks with counters, sketches and the narrowing rank search, gauges."""

import json
import random

import pytest
from pyspark.sql import functions as F

from logloom.functions.redact import RuleSet, StaticRule
from logloom.operators import meter, quantiles
from logloom.sinks.tables import write_topics
from logloom.sources.logs import kafka_options, scan_messages, split_list
from logloom.streaming import flows as streaming


@pytest.fixture
def written(spark, tmp_path):
    rows = [(t, f"{t}{n}", None) for t in ("app_view_logs", "app_error_logs", "other_logs", "app_view") for n in range(3)]
    write_topics(spark.createDataFrame(rows, "topic string, value string, headers array<struct<key:string,value:binary>>"), f"{tmp_path}/topics")
    return f"{tmp_path}/topics"


@pytest.mark.parametrize(
    ("asked", "topics"),
    [
        ({"prefix": "app_", "suffix": "_logs"}, {"app_view_logs", "app_error_logs"}),
        ({"prefix": "app_"}, {"app_view_logs", "app_error_logs", "app_view"}),
        ({"pattern": "r_lo"}, {"app_error_logs", "other_logs"}),
        ({}, {"app_view_logs", "app_error_logs", "other_logs", "app_view"}),
    ],
)
def test_only_the_folders_of_chosen_topics_are_opened(spark, written, asked, topics):
    found = scan_messages(spark, written, format="parquet", **asked)
    assert {r.topic for r in found.collect()} == topics and found.count() == 3 * len(topics)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not asked or "topic#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    opened = {r[0].split("topic=")[1].split("/")[0] for r in found.select(F.input_file_name()).distinct().collect()}
    assert opened == topics


def test_a_table_of_topics_prunes_while_the_query_runs(spark, written):
    chosen = spark.createDataFrame([("other_logs", 1), ("none", 2)], "topic string, n int").filter("n < 5")
    found = scan_messages(spark, written, format="parquet", topics=chosen)
    assert {r.topic for r in found.collect()} == {"other_logs"}


def test_broker_options():
    newest = kafka_options(servers="a:1, b:2", prefix="app.", suffix="_logs", group="g")
    assert newest["subscribePattern"] == r"app\..*_logs" and newest["startingOffsets"] == "latest" and newest["kafka.bootstrap.servers"] == "a:1,b:2"
    assert newest["groupIdPrefix"] == "g" and "maxOffsetsPerTrigger" not in newest
    oldest = kafka_options(servers="a", topic="t", group="g", from_oldest=True, max_per_trigger=10)
    assert (oldest["subscribe"], oldest["startingOffsets"], oldest["groupIdPrefix"], oldest["maxOffsetsPerTrigger"]) == ("t", "earliest", "g_t", "10")
    assert kafka_options(servers="a", topic="t", group="archive-", archive=True)["groupIdPrefix"] == "archive-t"
    assert kafka_options(servers="a", pattern="x|y")["subscribePattern"] == ".*(?:x|y).*"
    assert split_list(" a ,,b, ") == ["a", "b"] and split_list("") == []


def messages(spark, folder):
    good = json.dumps({"context": {"es_index_prefix": "p", "kafka_topic": "t"}, "timestamp": "s", "content": '{"a":"x"}'})
    rows = spark.createDataFrame([("t", good, None), ("t", good, None), ("t", "broken", None)], "topic string, value string, headers array<struct<key:string,value:binary>>")
    rows.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


def test_hooks_get_the_counts_of_the_pass_that_wrote(spark, tmp_path):
    seen = []
    hooks = streaming.Hooks(on_success=seen.append, counters=f"{tmp_path}/counters")
    for _ in range(2):
        stream = messages(spark, f"{tmp_path}/in")
        streaming.index_stream(stream, f"{tmp_path}/index", f"{tmp_path}/dead", f"{tmp_path}/cp", {}, clock=F.lit("2024-01-02").cast("timestamp"), hooks=hooks).awaitTermination()
    size = spark.read.parquet(f"{tmp_path}/index").agg(F.sum(F.octet_length("document"))).first()[0]
    assert [{k: c[k] for k in ("batch_id", "records", "stored", "failed")} for c in seen] == [{"batch_id": n, "records": 3, "stored": 2, "failed": 1} for n in (0, 1)]
    assert sum(c["bytes"] for c in seen) == size
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/counters").select("batch_id", "records", "bytes").collect()) == [(c["batch_id"], 3, c["bytes"]) for c in seen]


def test_a_failing_batch_calls_its_hook_and_stops(spark, tmp_path):
    errors = []
    hooks = streaming.Hooks(on_error=lambda batch, error: errors.append((batch, str(error))))
    query = streaming.archive_stream(messages(spark, f"{tmp_path}/in"), f"{tmp_path}/lines", f"{tmp_path}/cp", compression="none such", hooks=hooks)
    with pytest.raises(Exception, match="none such"):
        query.awaitTermination()
    assert [b for b, _ in errors] == [0] and "none such" in errors[0][1]


def test_hours_roll_up_to_days_without_the_rows(spark, tmp_path):
    rows = spark.range(50_000).select(
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 5).alias("ts"), F.when(F.col("id") % 50 != 0, F.pow(F.rand(3), 3) * 100).alias("v"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("l")
    ).persist()
    quantiles.sketches(rows, "v", "l", every="1 hour").write.parquet(f"{tmp_path}/hours")
    days = quantiles.sketched_quantiles(quantiles.merged_sketches(spark.read.parquet(f"{tmp_path}/hours"), "l", every="1 day"), (0.5, 0.99)).collect()
    values = {}
    for r in rows.withColumn("d", F.date_trunc("day", "ts")).filter("v IS NOT NULL").collect():
        values.setdefault((r.l, r.d), []).append(r.v)
    assert {(r.l, r.window_start) for r in days} == set(values)
    for r in days:
        own = values[r.l, r.window_start]
        assert r.n == len(own)
        for q, found in ((0.5, r.p50), (0.99, r.p99)):
            assert abs(sum(v <= found for v in own) / len(own) - q) < 0.012
    none = quantiles.sketched_quantiles(quantiles.sketches(rows.filter("v IS NULL"), "v", "l"), (0.5,)).collect()
    assert {(r.l, r.n, r.p50) for r in none} == {("a", 0, None), ("b", 0, None)}


@pytest.mark.parametrize("kind", ["spread", "skewed", "ties"])
def test_wide_brackets_are_narrowed(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "ORDERED", 5)
    monkeypatch.setattr(quantiles, "BINS", 4)
    source = random.Random(kind)
    make = {"spread": lambda: source.uniform(-5, 5), "skewed": lambda: source.random() ** 40 * 1e12, "ties": lambda: float(source.choice([1, 1, 1, 2, 3]))}[kind]
    rows = [(source.choice("ab"), make()) for _ in range(4000)]
    found = quantiles.exact_quantiles(spark.createDataFrame(rows, "l string, v double"), "v", ["l"], (0.1, 0.5, 0.99), accuracy=50).collect()
    for r in found:
        own = sorted(v for l, v in rows if l == r.l)  # noqa: E741
        assert (r.p10, r.p50, r.p99) == tuple(own[-(-len(own) * q // 100) - 1] for q in (10, 50, 99))


def test_gauges_and_redacted_bytes(spark):
    rows = spark.createDataFrame([("a", 1, 1, 10), ("a", 1, 2, 5), ("a", 0, 3, 99), ("b", 0, 1, 7)], "l string, ts int, seq int, v int")
    assert sorted(tuple(r) for r in meter.with_info(meter.last_value(rows, "v", "l", seq="seq")).collect()) == [("a", 5, 1), ("b", 7, 1)]
    assert sorted(tuple(r) for r in meter.last_value(rows, "v", "l").collect()) == [("a", 10), ("b", 7)]
    texts = spark.createDataFrame([("x", "éa"), ("y", "abc"), ("z", "q"), (None, "null")], "app string, text string")
    some = RuleSet(static=(StaticRule("S", "x"),))
    named = lambda rules: sorted((r.app or "", r.bytes) for r in meter.redacted_bytes(texts, rules, "app", "text").collect())
    assert named({"x": some, "y": RuleSet()}) == [("x", 3)]
    assert named({"default": some, "y": RuleSet()}) == [("", 4), ("x", 3), ("z", 1)]
    assert named({}) == []
