import json

from pyspark.sql import functions as F

from logloom import schema
from logloom.functions import document as d
from logloom.operators import envelope, meter, topics
from logloom.operators.documents import archive_lines, search_documents
from logloom.sources.logs import kafka_options


def contents(spark, texts):
    return spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], "i int, content string, timestamp string")


def test_search_documents(spark):
    texts = ["{}", None, "null", '{"a": 1', '{"@timestamp": null}', '{"0": 1}', '{"a":{"@timestamp":"deep"}}']
    found = [(r.document, r.error) for r in search_documents(contents(spark, texts)).orderBy("i").collect()]
    assert found == [
        ('{"@timestamp":""}', None),
        (None, schema.CONTENT_MISSING),
        (None, schema.FIELDS_MISSING),
        (None, schema.JSON_ERROR),
        ('{"@timestamp":null}', None),
        ('{"0":1,"@timestamp":""}', None),
        ('{"a":{"@timestamp":"deep"},"@timestamp":""}', None),
    ]


def test_archive_lines(spark):
    def text(**fields):
        return json.dumps({"@message": "hi", "k8s_metadata": {"container_name": "c"}, **fields})

    texts = [
        text(), text(**{"@timestamp": "t"}), text(**{"@message": '{"x": [1, null]}'}), text(**{"@message": "[2]"}), text(**{"@message": "[2"}),
        text(**{"@message": ""}), text(**{"@message": 5}), text(k8s_metadata={}), text(k8s_metadata="c"),
        text(k8s_metadata={"container_name": 5}), None,
    ]
    found = [r.line or r.error for r in archive_lines(contents(spark, texts)).orderBy("i").collect()]
    assert found == [
        '{"message":"hi","log_tag":"c","log_time":""}',
        '{"message":"hi","log_tag":"c","log_time":"t"}',
        '{"message":{"x":[1,null]},"log_tag":"c","log_time":""}',
        '{"message":[2],"log_tag":"c","log_time":""}',
        schema.JSON_ERROR,
        schema.FIELDS_MISSING,
        schema.FIELDS_MISSING,
        schema.FIELDS_MISSING,
        schema.FIELDS_MISSING,
        '{"message":"hi","log_tag":"","log_time":""}',
        schema.CONTENT_MISSING,
    ]


def test_batches_round_trip(spark):
    records = spark.createDataFrame(
        [(1, n, "2024-06-01T12:00:00Z", json.dumps({"n": n})) for n in range(25)], "b int, n int, timestamp string, content string"
    ).withColumn("context", F.struct(F.lit("t").alias("kafka_topic"), F.lit(5).alias("app_max_tps")))
    batches = envelope.collect_batch(records, ["context", "b"], "n", max_items=10)
    assert sorted((r.part, len(r["items"])) for r in batches.collect()) == [(0, 10), (1, 10), (2, 5)]
    decoded = envelope.decode(envelope.encode_collection(batches).drop("items", "context"))
    rows = envelope.explode_batch(decoded).select("part", "position", "context.kafka_topic", "content").collect()
    assert all(json.loads(r.content)["n"] == r.part * 10 + r.position and r.kafka_topic == "t" for r in rows) and len(rows) == 25
    single = envelope.decode(envelope.encode_single(records.select("context", "timestamp", "content")).select("value", "headers"))
    assert {len(r["items"]) for r in single.collect()} == {1}


def test_content_may_be_an_object(spark):
    value = '{"context":{"kafka_topic":"t"},"timestamp":"x","content":{"a":[1,"b"]}}'
    row = spark.createDataFrame([(value, None), ("invalid_proto", None)], "value string, headers array<struct<key:string,value:binary>>")
    good, bad = envelope.split_errors(envelope.decode(row))
    assert json.loads(good.first()["items"][0].content) == {"a": [1, "b"]}
    assert bad.first().error == schema.PARSE_ERROR


def test_topics(spark):
    names = spark.createDataFrame([("topic1",), ("topic2",), ("foo",)], "topic string")
    assert sorted(r.topic for r in names.filter(topics.matches_pattern(F.col("topic"), "topic.*")).collect()) == ["topic1", "topic2"]
    seen = spark.createDataFrame([("topic002",), ("topic001",), ("topic002",)], "topic string")
    known = spark.createDataFrame([("topic001",)], "topic string")
    assert [r.topic for r in topics.new_topics(seen, known).collect()] == ["topic002"]
    assert kafka_options(servers="s", pattern="a|b")["subscribePattern"] == ".*(?:a|b).*"
    assert kafka_options(servers="s", prefix="p.", suffix="_x", from_oldest=True)["subscribePattern"] == "p\\..*_x"
    assert kafka_options(servers="s", topic="t", group="g")["groupIdPrefix"] == "g_t"


def test_names(spark):
    row = spark.createDataFrame([("authorization-service", "index-one-2020.12.31", "reason")], "t string, i string, r string")
    at = F.to_timestamp(F.lit("2021-01-01 00:00:00"))
    found = row.select(
        d.archive_path("/bar", F.col("t"), at), d.index_base(F.col("i")), d.error_class(F.col("r")), d.app_name(F.lit("a_logs"), ""),
        d.error_class(F.lit("x"), F.lit("mapper broke")),
    ).first()
    assert tuple(found) == (
        "/bar/authorization-service/authorization-service-2021-01-01T00:00:00Z.log", "index-one", "undefined_error", "a_logs", "mapping_failed",
    )


def test_usage_report(spark):
    rows = spark.createDataFrame([("some-secret-1234", True, 5)], "app_secret string, ok boolean, at int")
    report = meter.usage_report(rows.withColumn("ts", F.timestamp_seconds("at"))).first().report
    assert report == '{"application_groups":[{"token":"some-secret-1234","new_log_count":1}]}'


def test_a_batch_is_one_message_and_its_parts_are_dense(spark):
    rows = [(1, n, "t", "c") for n in range(9998, 10002)]
    records = spark.createDataFrame(rows, "b int, n int, timestamp string, content string")
    assert [(r.part, len(r["items"])) for r in envelope.collect_batch(records, ["b"], "n").collect()] == [(0, 4)]
    parts = envelope.collect_batch(records, ["b"], "n", max_items=3).collect()
    assert sorted((r.part, len(r["items"])) for r in parts) == [(0, 3), (1, 1)]


def test_a_collection_without_items_is_an_error(spark):
    header = [(schema.FORMAT_HEADER if hasattr(schema, "FORMAT_HEADER") else envelope.FORMAT_HEADER, bytearray(envelope.COLLECTION_FORMAT, "ascii"))]
    rows = spark.createDataFrame([('{"context":{"kafka_topic":"t"}}', header)], "value string, headers array<struct<key:string,value:binary>>")
    good, bad = envelope.split_errors(envelope.decode(rows))
    assert good.count() == 0 and bad.first().error == schema.PARSE_ERROR
