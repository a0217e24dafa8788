"""Log records, messages and requests derived from the given tables, with the same derivations in SQL.

The SQL constants are common table expressions for the DuckDB side of the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.document import log_bytes, rate_key, topic_name
from logloom.schema import COLLECTION_FORMAT, FORMAT_HEADER
from logloom.session import scratch, spread  # noqa: F401 - queries write below i.scratch

# One second of arrival time stands for one hour of event time, so that rate-limit windows of
# seconds hold enough requests to be contested.
SPEEDUP = 3600
PREFIX = "app_"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def from_events(events: DataFrame) -> DataFrame:
    """Events as log records: envelope context, arrival time, JSON content."""
    i = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    context = F.struct(
        F.col("event_type").alias("kafka_topic"),
        (1 + i % 3).cast("int").alias("kafka_partition"),
        (1 + i % 2).cast("int").alias("kafka_replication_factor"),
        F.concat(F.lit("idx_"), F.col("event_type")).alias("es_index_prefix"),
        F.lit("_doc").alias("es_document_type"),
        (1 + F.length("event_type") % 3).cast("int").alias("app_max_tps"),
        F.col("user_id").cast("string").alias("app_secret"),
        (F.col("user_id") % 10 == 0).alias("disable_app_tps"),
        F.lit(2).alias("app_group_max_tps"),
    )
    return events.select(
        "event_id",
        ts.alias("ts"),
        F.timestamp_micros(F.expr(f"unix_micros(cast(ts as timestamp)) div {SPEEDUP}")).alias("arrival"),
        topic_name(F.col("event_type"), PREFIX).alias("topic"),
        context.alias("context"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.col("props").alias("content"),
        "value",
    )


def event_stream(spark: SparkSession, sf: str, batch_bytes: int = 256 << 20) -> DataFrame:
    """The events as a stream; a micro-batch takes files of so many bytes, one at least."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxBytesPerTrigger", str(batch_bytes)).parquet(sf)


def drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What a stream wrote until its source had nothing more."""
    out = scratch(spark, name)
    (
        stream.writeStream.format("parquet").option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def logs(spark: SparkSession, sf: str) -> DataFrame:
    return from_events(table(spark, sf, "events"))


LOGS = f"""logs AS (
  SELECT event_id, ts, epoch_us(ts) // {SPEEDUP} AS arrival_us,
         '{PREFIX}' || event_type || '_logs' AS topic, event_type, user_id,
         'idx_' || event_type AS es_index_prefix,
         1 + length(event_type) % 3 AS app_max_tps, user_id % 10 = 0 AS disable_app_tps,
         strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, props, value
  FROM events)"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return requests_of(logs(spark, sf))


def requests_of(records: DataFrame) -> DataFrame:
    """Log records as rate-limited requests: bucket key, quota, cost and size."""
    bucket = rate_key(F.col("context"), F.col("topic"))
    return records.select(
        "event_id",
        "arrival",
        "topic",
        bucket.getField("key").alias("key"),
        bucket.getField("max_tps").alias("max_tps"),
        (1 + F.col("event_id") % 3).cast("long").alias("cost"),
        log_bytes(F.col("topic"), F.col("timestamp"), F.col("content")).alias("bytes"),
    )


REQUESTS = f"""{LOGS}, requests AS (
  SELECT event_id, arrival_us, topic,
         CASE WHEN disable_app_tps THEN 'app_group' ELSE topic END AS key,
         CASE WHEN disable_app_tps THEN 2 ELSE app_max_tps END AS max_tps,
         1 + event_id % 3 AS cost,
         strlen(to_json({{'topic': topic, 'timestamp': stamp, 'content': props}})::VARCHAR) AS bytes
  FROM logs)"""


def messages(spark_or_events, sf: str | None = None) -> DataFrame:
    """Topic messages: single records and batches of two, some unreadable, some without content.

    Two headers of the same name check that the first one decides.
    """
    events = spark_or_events if sf is None else spread(table(spark_or_events, sf, "events"))
    i = F.col("event_id")
    content = F.when(i % 10 == 8, F.lit(None)).when(i % 10 == 7, F.lit("[7]")).otherwise(F.col("content"))
    following = F.concat(F.lit('{"k": '), (F.get_json_object("content", "$.k").cast("long") + 1).cast("string"), F.lit("}"))
    single = F.to_json(F.struct("context", "timestamp", content.alias("content")))
    batch = F.to_json(
        F.struct(
            "context",
            F.array(
                F.struct("timestamp", content.alias("content")), F.struct("timestamp", following.alias("content"))
            ).alias("items"),
        )
    )

    def header(key: str, value: str):
        return F.struct(F.lit(key).alias("key"), F.lit(value).cast("binary").alias("value"))

    headers = (
        F.when(i % 3 == 0, F.array(header(FORMAT_HEADER, COLLECTION_FORMAT)))
        .when(i % 3 == 1, F.array().cast("array<struct<key:string,value:binary>>"))
        .otherwise(F.array(header("other", "x"), header(FORMAT_HEADER, "Timber"), header(FORMAT_HEADER, COLLECTION_FORMAT)))
    )
    return from_events(events).select(
        "event_id",
        "ts",
        "topic",
        F.when(i % 10 == 9, F.lit("invalid_proto")).when(i % 3 == 0, batch).otherwise(single).alias("value"),
        headers.alias("headers"),
    )


# What the messages mean once read: one row per item.
MESSAGES = f"""{LOGS}, items AS (
  SELECT l.*, p.position,
         CASE WHEN p.position = 1 THEN '{{"k": ' || (CAST(json_extract(props, '$.k') AS BIGINT) + 1) || '}}'
              WHEN event_id % 10 = 8 THEN NULL WHEN event_id % 10 = 7 THEN '[7]' ELSE props END AS content
  FROM logs l, (VALUES (0), (1)) p(position)
  WHERE event_id % 10 <> 9 AND (p.position = 0 OR event_id % 3 = 0)),
documented AS (
  SELECT *, CASE WHEN content IS NULL THEN 'Timber Content Missing Error'
                 WHEN content = '[7]' THEN 'Timber Field Missing Error' END AS error FROM items)"""


def document_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as log records of many topics, one per source and language."""
    i = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat_ws("_", "source", "lang").alias("topic"),
        F.struct(
            (1 + i % 3).cast("int").alias("kafka_partition"), (1 + i % 2).cast("int").alias("kafka_replication_factor")
        ).alias("context"),
    )


def toxic_topics(spark: SparkSession, sf: str) -> DataFrame:
    """The registry of known topics: those with a document labelled toxic."""
    toxic = table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    return document_logs(spark, sf).join(toxic, "doc_id", "left_semi").select("topic").distinct()


REGISTRY = """doc_logs AS (SELECT doc_id, source || '_' || lang AS topic FROM documents),
registry AS (SELECT DISTINCT topic FROM doc_logs WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))"""


def rule_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Rule files as JSON texts, one application per document."""
    name, length = F.upper("lang"), F.lit(4)
    rule = T.StructType().add("Name", "string").add("Regex", "string").add("HintCharsStart", "integer").add("HintCharsEnd", "integer")
    path = T.StructType().add("Name", "string").add("Path", "string").add("HintCharsStart", "integer").add("HintCharsEnd", "integer")
    static = F.struct(
        name.alias("Name"),
        F.concat(F.lit("[a-z]+@"), F.col("source"), F.lit("\\.com")).alias("Regex"),
        (F.col("doc_id") % length).cast("int").alias("HintCharsStart"),
        F.lit(0).alias("HintCharsEnd"),
    ).cast(rule)
    paths = F.struct(
        name.alias("Name"), F.lit("users.email").alias("Path"), F.lit(0).alias("HintCharsStart"), F.lit(0).alias("HintCharsEnd")
    ).cast(path)
    sets = F.struct(
        F.array(static).alias("StaticRules"),
        F.when(F.col("doc_id") % 2 == 0, F.array(paths)).otherwise(F.array().cast(T.ArrayType(path))).alias("JsonPathRules"),
    )
    app = F.concat_ws("-", "source", F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(F.to_json(F.create_map(app, sets)).alias("value"))
