import json

from pyspark.sql import functions as F

from check import TABLES, compare
from logloom.operators.meter import count_by
from logloom.plans import inputs
from logloom.sources.logs import scan_messages
from logloom.sources.rules import LiveRules
from logloom.streaming import flows as streaming

SF = "/root/testdata/sf0.001"


def event_stream(spark):
    schema = inputs.table(spark, SF, "events").schema
    return inputs.from_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF))


def drained(spark, df, path, mode="append"):
    query = (
        df.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    return spark.read.parquet(f"{path}/out")


def test_windowed_counts_equal_batch(spark, tmp_path):
    streamed = drained(spark, streaming.count_stream(event_stream(spark), "topic", late="1 hour"), str(tmp_path))
    batch = count_by(inputs.logs(spark, SF), "topic", every="1 hour")
    closed = streamed.agg(F.max("window_start")).first()[0]
    wanted = batch.filter(F.col("window_start") <= F.lit(closed)).select("topic", "window_start", "n")
    assert sorted(map(tuple, streamed.select("topic", "window_start", "n").collect())) == sorted(map(tuple, wanted.collect()))


def test_topics_appear_once(spark, tmp_path):
    found = [r.topic for r in drained(spark, streaming.topic_stream(event_stream(spark)), str(tmp_path)).collect()]
    assert len(found) == len(set(found)) == 5


def test_rules_refresh_keeps_the_last_good_set(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"a": {"StaticRules": [{"Name": "N", "Regex": "x"}]}}))
    live = LiveRules(spark, str(path))
    assert set(live.current) == {"a"}
    path.write_text("{ broken")
    assert set(live.refresh()) == {"a"} and live.last_error is not None
    path.write_text(json.dumps({"b": {}}))
    assert set(live.refresh()) == {"b"} and live.last_error is None


def test_scan_and_index_stream_with_dead_letters(spark, tmp_path):
    folder = tmp_path / "messages"
    folder.mkdir()
    rows = [{"topic": "t", "value": json.dumps({"context": {"es_index_prefix": "p"}, "timestamp": "s", "content": '{"a":"x"}'})}]
    rows += [{"topic": "t", "value": "broken"}]
    (folder / "1.json").write_text("\n".join(map(json.dumps, rows)))
    messages = scan_messages(spark, str(folder), stream=True, maxFilesPerTrigger=1)
    rules = tmp_path / "rules.json"
    rules.write_text(json.dumps({"default": {"StaticRules": [{"Name": "N", "Regex": "x"}]}}))
    out = str(tmp_path)
    streaming.index_stream(
        messages, f"{out}/index", f"{out}/dead", f"{out}/cp", LiveRules(spark, str(rules)), clock=F.lit("2024-01-02").cast("timestamp")
    ).awaitTermination(120)
    stored = spark.read.parquet(f"{out}/index").first()
    assert (stored.index_name, stored.document) == ("p-2024.01.02", '{"a":"[N REDACTED]","@timestamp":"s"}')
    assert [r.error for r in spark.read.parquet(f"{out}/dead").collect()] == ["Protobuf Parse Error"]


def test_streamed_verdicts_do_not_depend_on_file_order(spark, tmp_path):
    import duckdb

    source = "/root/testdata/sf0.01"
    for name in TABLES:
        if name != "events":
            (tmp_path / f"{name}.parquet").symlink_to(f"{source}/{name}.parquet")
    with duckdb.connect() as db:
        db.execute(f"COPY (SELECT * FROM read_parquet('{source}/events.parquet') ORDER BY hash(event_id)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    # several Arrow batches a key: `configure` keeps them at 512 rows
    assert compare(spark, str(tmp_path), "stream_admit") is None


def test_archive_stream_keeps_failed_messages(spark, tmp_path):
    messages = spark.createDataFrame(
        [("t", '{"context":{"kafka_topic":"t"},"timestamp":"x","content":{"a":1}}', None), ("t", "unreadable", None)],
        "topic string, value string, headers array<struct<key:string,value:binary>>",
    )
    messages.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(messages.schema).parquet(f"{tmp_path}/in")
    streaming.archive_stream(stream, f"{tmp_path}/lines", f"{tmp_path}/checkpoint", simple=False, dead_letters=f"{tmp_path}/dead").awaitTermination()
    assert spark.read.text(f"{tmp_path}/lines").count() == 1
    assert [r.value for r in spark.read.parquet(f"{tmp_path}/dead").collect()] == ["unreadable"]
