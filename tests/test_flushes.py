"""The flush sink and its manifest, the topic registry, and archives that keep their failures."""

import gzip
from pathlib import Path

import pytest
from pyspark.sql import DataFrameReader, DataFrameWriter
from pyspark.sql import functions as F

from logloom.operators.segments import flush_segments
from logloom.operators.topics import topic_events
from logloom.sinks import flushes, registry
from logloom.streaming import flows as streaming

SCHEMA = "topic string, ts timestamp, event_id long, line string"


def lines(spark, count=400, start=0):
    rows = spark.range(start, start + count).select(
        F.when(F.col("id") % 4 == 0, "cold").otherwise("hot").alias("topic"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 7).alias("ts"),
        F.col("id").alias("event_id"),
        F.concat(F.lit("line "), F.repeat(F.lit("x"), (F.col("id") % 9).cast("int")), F.lit(" "), F.col("id")).alias("line"),
    )
    return rows.repartition(3)


def test_one_object_per_flush_in_order(spark, tmp_path):
    path, seen = str(tmp_path / "archive"), []
    manifest = flushes.write_flushes(lines(spark), path, 3, seq="event_id", max_bytes=300, max_seconds=600, on_flush=lambda rows: seen.append(rows.count())).collect()
    sized = lines(spark).withColumn("bytes", F.octet_length("line"))
    wanted = {
        (r.topic, r.flush_window, r.segment): (r.lines, r.bytes, r.ids)
        for r in flush_segments(sized, seq="event_id", max_bytes=300, max_seconds=600)
        .groupBy("topic", "flush_window", "segment").agg(F.count("*").alias("lines"), F.sum("bytes").alias("bytes"), F.sort_array(F.collect_list("event_id")).alias("ids")).collect()
    }
    assert {(r.topic, r.flush_window, r.segment): (r.lines, r.bytes) for r in manifest} == {k: v[:2] for k, v in wanted.items()}
    assert seen == [len(wanted)] and {r.outcome for r in manifest} == {"success"} and len({(r.topic, r.object) for r in manifest}) == len(wanted)
    for r in manifest:
        folder = Path(path) / "batch_id=3" / f"topic={r.topic}" / f"object={r.object.replace(':', '%3A')}"
        parts = list(folder.glob("*.gz"))
        assert len(parts) == 1 and r.object.startswith(f"{r.topic}-2023-11-1") and ".log.gz" in r.object
        text = gzip.decompress(parts[0].read_bytes()).decode().splitlines()
        assert [int(t.split()[-1]) for t in text] == wanted[r.topic, r.flush_window, r.segment][2]


@pytest.mark.parametrize("compression", ["gzip", "", "zstd"])
def test_readers_trust_the_manifest_only(spark, tmp_path, compression):
    path = str(tmp_path / "archive")
    options = dict(seq="event_id", max_bytes=500, max_seconds=600, compression=compression)
    flushes.write_flushes(lines(spark), path, 0, **options)
    flushes.write_flushes(lines(spark, 100, 400), path, 1, **options)
    flushes.write_flushes(lines(spark, 50, 400), path, 1, **options)  # the batch again, with less in it
    stray = tmp_path / "archive" / "batch_id=2" / "topic=hot" / "object=hot-x.log"
    (stray).mkdir(parents=True)
    if compression != "zstd":
        (stray / "part-0.txt").write_text("left by a run that failed\n")
    found = flushes.read_archive(spark, path, compression)
    assert sorted(int(r.value.split()[-1]) for r in found.collect()) == list(range(450))
    total = {(r.topic, r.outcome): (r.uploads, r["lines"]) for r in flushes.uploads(flushes.read_manifest(spark, path), "topic").collect()}
    assert sum(n for _, n in total.values()) == 450 and {o for _, o in total} == {"success"}


@pytest.mark.parametrize("compression", ["gzip", ""])
def test_tasks_read_and_write_objects_as_spark_does(spark, tmp_path, monkeypatch, compression):
    path = str(tmp_path / "archive")
    odd = F.element_at(F.array(*map(F.lit, ["a/b", "c=d %{[^]}", "ü: #\"'*?\\", "plain\x01\x7f"])), (F.col("event_id") % 4 + 1).cast("int"))
    text = F.when(F.col("event_id") % 5 == 0, F.concat("line", F.lit("\r\n\nü\rx\r\n"))).otherwise(F.col("line"))
    flushes.write_flushes(lines(spark).withColumns({"topic": odd, "line": text}), path, seq="event_id", max_bytes=200, max_seconds=600, compression=compression)
    manifest = {(r.topic, r.object) for r in flushes.read_manifest(spark, path).collect()}
    listed = [r.value for r in spark.read.text(f"{path}/batch_id=-1/_objects").collect()]
    assert len(manifest) == len(set(listed)) == len(listed) > 30 and all((tmp_path / "archive" / "batch_id=-1" / name).is_dir() for name in listed)
    assert not [f for f in (tmp_path / "archive" / "batch_id=-1").glob("topic=*/object=*/.*")]
    (tmp_path / "archive" / "batch_id=-1" / "_objects" / "_SUCCESS").rename(tmp_path / "aside")
    by_spark = sorted(map(tuple, flushes.read_archive(spark, path).collect()))
    (tmp_path / "aside").rename(tmp_path / "archive" / "batch_id=-1" / "_objects" / "_SUCCESS")

    def refuse(*_):
        raise OSError("lists all objects")

    monkeypatch.setattr(DataFrameReader, "load", refuse)
    found = flushes.read_archive(spark, path)
    assert sorted(map(tuple, found.collect())) == by_spark and {r[:2] for r in by_spark} == manifest
    assert found.rdd.getNumPartitions() > 1


def test_nothing_vouches_for_a_batch_whose_second_run_failed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "archive")
    flushes.write_flushes(lines(spark, 40), path, 0, seq="event_id", max_bytes=100)
    flushes.write_flushes(lines(spark, 40, 40), path, 1, seq="event_id", max_bytes=100)

    def refuse(*_):
        raise OSError("no space")

    with monkeypatch.context() as patch, pytest.raises(OSError):
        patch.setattr(DataFrameWriter, "text", refuse)
        flushes.write_flushes(lines(spark, 40), path, 0, seq="event_id", max_bytes=100)
    assert {r.batch_id for r in flushes.read_manifest(spark, path).collect()} == {1}
    assert sorted(int(r.value.split()[-1]) for r in flushes.read_archive(spark, path).collect()) == list(range(40, 80))


def test_a_failed_write_is_noted_and_raised(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    def refuse(*_):
        raise OSError("no space")

    monkeypatch.setattr(DataFrameWriter, "text", refuse)
    path = str(tmp_path / "archive")
    with pytest.raises(OSError):
        flushes.write_flushes(lines(spark, 20), path, 0, seq="event_id", max_bytes=100)
    assert flushes.read_manifest(spark, path).count() == 0
    noted = flushes.read_manifest(spark, path, failures=True).collect()
    assert noted and {(r.outcome, r.error) for r in noted} == {("failure", "no space")}
    assert {r.outcome for r in flushes.uploads(flushes.read_manifest(spark, path, failures=True)).collect()} == {"failure"}


def test_nulls_and_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(None, None, None, "a"), ("t", None, 1, None), ("t", None, 2, "")], SCHEMA)
    flushes.write_flushes(rows, str(tmp_path / "a"), seq="event_id", compression="")
    assert sorted((r.topic, r.value) for r in flushes.read_archive(spark, str(tmp_path / "a"), "").collect() if r.topic) == [("t", "")]
    assert sorted((r.topic or "", r["lines"], r.bytes) for r in flushes.read_manifest(spark, str(tmp_path / "a")).collect()) == [("", 1, 1), ("t", 1, 0)]
    assert flushes.write_flushes(rows.limit(0), str(tmp_path / "b"), seq="event_id").collect() == []


def logs(spark, rows):
    context = F.struct(F.col("p").alias("kafka_partition"), F.lit(1).alias("kafka_replication_factor"))
    return spark.createDataFrame(rows, "topic string, at int, p int").select("topic", "at", context.alias("context"))


def test_each_topic_is_registered_once_whatever_is_replayed(spark, tmp_path):
    path, told = str(tmp_path / "topics"), []
    announce = lambda rows: told.append(sorted(r.topic for r in rows.collect()))
    first, second = logs(spark, [("a", 2, 9), ("a", 1, 3), ("b", 1, 4)]), logs(spark, [("a", 0, 1), ("c", 5, 6), ("c", 4, 5)])
    registry.register_topics(first, path, 0, ["at"], announce=announce)
    registry.register_topics(second, path, 1, ["at"], announce=announce)
    registry.register_topics(first, path, 0, ["at"], announce=announce)  # replayed: new again, and replaced
    registry.register_topics(second, path, 1, ["at"], announce=announce)
    registry.register_topics(first, path, 2, ["at"], announce=announce)
    found = sorted((r.topic, r.partitions, r.batch_id) for r in registry.read_registry(spark, path).collect())
    assert found == [("a", 3, 0), ("b", 4, 0), ("c", 5, 1)]
    assert told == [["a", "b"], ["c"], ["a", "b"], ["c"], []]
    assert registry.read_registry(spark, str(tmp_path / "none")).collect() == []


def test_first_records_are_found_without_a_shuffle_of_records(spark):
    rows = [("a", 2, 9), ("a", 1, 3), ("a", 1, 2), ("b", None, 5), ("b", 1, 4), ("c", 7, None), ("c", 7, 1), ("d", 1, 1), (None, 1, 1), ("a", 1, 2)]
    unsized = logs(spark, rows)
    unsized = spark.createDataFrame(unsized.rdd, unsized.schema)  # as a micro-batch: nobody knows how large it is
    found = topic_events(unsized, spark.createDataFrame([("d",)], "topic string"), ["at"])
    assert sorted((r.topic, r.partitions) for r in found.collect()) == [("a", 2), ("b", 5), ("c", None)]
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_the_registry_of_a_restarted_stream(spark, tmp_path):
    for n, topics in enumerate((["a", "b"], ["b", "c"], ["a"])):
        spark.createDataFrame([(t, n) for t in topics], "topic string, at int").write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema("topic string, at int").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        context = F.struct(F.lit(2).alias("kafka_partition"), F.lit(1).alias("kafka_replication_factor"))
        registry.registry_stream(stream.withColumn("context", context), f"{tmp_path}/topics", f"{tmp_path}/cp", ["at"]).awaitTermination()
    assert sorted((r.topic, r.batch_id) for r in registry.read_registry(spark, f"{tmp_path}/topics").collect()) == [("a", 0), ("b", 0), ("c", 1)]


def test_archive_failures_are_kept_by_default(spark, tmp_path):
    messages = spark.createDataFrame(
        [("t", '{"context":{"kafka_topic":"t"},"timestamp":"x","content":{"a":1}}', None), ("t", "unreadable", None)],
        "topic string, value string, headers array<struct<key:string,value:binary>>",
    )
    messages.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(messages.schema).parquet(f"{tmp_path}/in")
    streaming.archive_stream(stream, f"{tmp_path}/lines", f"{tmp_path}/checkpoint", simple=False).awaitTermination()
    assert spark.read.text(f"{tmp_path}/lines").count() == 1
    assert [r.value for r in spark.read.parquet(f"{tmp_path}/lines/_dead_letters").collect()] == ["unreadable"]
