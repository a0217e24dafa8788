"""Queries: sinks, whole flows and their streaming forms, each written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions.redact import PathRule, RuleSet, StaticRule, redact_by_app
from logloom.operators import envelope
from logloom.plans import flows
from logloom.plans import inputs as i
from logloom.plans.limits import SECONDS
from logloom.plans.redaction import BY_APP_SQL, RULES, texts
from logloom.plans.registry import query
from logloom.sinks import flushes, registry, tables
from logloom.streaming import flows as streaming


@query(
    "sink_topic",
    f"""WITH {i.LOGS} SELECT topic, count(*) AS messages, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS collections,
    CAST(sum(CASE WHEN event_id % 10 = 9 THEN 1 ELSE 0 END) AS BIGINT) AS unreadable FROM logs GROUP BY topic""",
)
def sink_topic(spark, sf):
    out = i.scratch(spark, "topics")
    tables.write_topics(i.messages(spark, sf), out)
    stored = envelope.decode(spark.read.parquet(out))
    return stored.groupBy("topic").agg(
        F.count("*").alias("messages"),
        F.count_if(envelope.is_collection(F.col("headers"))).alias("collections"),
        F.count_if(F.col("error").isNotNull()).alias("unreadable"),
    )


INDEX_RULES = {
    "default": RuleSet(paths=(PathRule("STAMP", r"@timestamp", keep_start=4),)),
    "idx_view": RuleSet(static=(StaticRule("NUM", r"\b\d\b"),)),
    "idx_click": RuleSet(),
}
_STAMPED = """CASE event_type WHEN 'click' THEN stamp WHEN 'view' THEN stamp ELSE left(stamp, 4) || '[STAMP REDACTED]' END"""
_K = "json_extract(content, '$.k')::VARCHAR"
_INDEXED = f"""SELECT event_id, position, es_index_prefix || '-' || strftime(ts, '%Y.%m.%d') AS index_name, {_STAMPED} AS at_timestamp,
  CASE WHEN event_type = 'view' AND length({_K}) = 1 THEN '[NUM REDACTED]' ELSE {_K} END AS k FROM documented WHERE error IS NULL"""


def _index_rows(documents):
    """Extract fields with patterns: a redacted number is no longer a JSON value."""
    return documents.select(
        "index_name",
        F.regexp_extract("document", '"@timestamp":"([^"]*)"', 1).alias("at_timestamp"),
        F.regexp_extract("document", r'"k":(\[NUM REDACTED\]|\d+)', 1).alias("k"),
    )


def _index_flow(spark, sf, **options):
    made = flows.to_index(i.messages(spark, sf), INDEX_RULES, F.col("ts"), **options).filter("error IS NULL")
    return made.select(
        "event_id", "position", "index_name",
        F.regexp_extract("document", '"@timestamp":"([^"]*)"', 1).alias("at_timestamp"),
        F.regexp_extract("document", r'"k":(\[NUM REDACTED\]|\d+)', 1).alias("k"),
    )


@query("index_flow", f"WITH {i.MESSAGES} {_INDEXED}")
def index_flow(spark, sf):
    return _index_flow(spark, sf)


@query("index_flow_discovered", f"WITH {i.MESSAGES} {_INDEXED}")
def index_flow_discovered(spark, sf):
    """Path rules by the shape found in the documents, without a Python stage."""
    return _index_flow(spark, sf, content_schema="discover")


_INDEX_COUNTS = f"WITH {i.MESSAGES}, d AS ({_INDEXED}) SELECT index_name, at_timestamp, k, count(*) AS n FROM d GROUP BY ALL"


def _counted(documents):
    return _index_rows(documents).groupBy("index_name", "at_timestamp", "k").agg(F.count("*").alias("n"))


@query("sink_index", _INDEX_COUNTS)
def sink_index(spark, sf):
    """Three batches and an append; one batch was first written under another clock, and its replay must leave nothing of that."""
    out = i.scratch(spark, "index")
    good, _ = envelope.split_errors(flows.to_index(i.messages(spark, sf), INDEX_RULES, F.col("ts")))
    late, _ = envelope.split_errors(flows.to_index(i.messages(spark, sf), INDEX_RULES, F.timestamp_micros(F.lit(0))))
    mine = F.pmod(F.col("event_id"), F.lit(5))
    tables.write_index(late.filter(mine == 1), out, batch_id=1)
    for batch in (0, 1, 2):
        tables.write_index(good.filter(mine == batch), out, batch_id=batch)
    for rest in (3, 4):
        tables.write_index(good.filter(mine == rest), out)
    return _counted(spark.read.parquet(out))


@query("stream_index", _INDEX_COUNTS)
def stream_index(spark, sf):
    out = i.scratch(spark, "stream-index")
    streaming.index_stream(
        i.messages(i.event_stream(spark, sf)), f"{out}/index", f"{out}/dead", f"{out}/checkpoint", INDEX_RULES, clock=F.col("ts")
    ).awaitTermination()
    return _counted(spark.read.parquet(f"{out}/index"))


@query("stream_index_discovered", _INDEX_COUNTS)
def stream_index_discovered(spark, sf):
    """Each micro-batch redacted by the shape found in it."""
    out = i.scratch(spark, "stream-index")
    streaming.index_stream(
        i.messages(i.event_stream(spark, sf)), f"{out}/index", f"{out}/dead", f"{out}/checkpoint", INDEX_RULES, clock=F.col("ts"), content_schema="discover"
    ).awaitTermination()
    return _counted(spark.read.parquet(f"{out}/index"))


_ARCHIVED = f"""SELECT topic, content = '[7]' AS listed, CAST({_K} AS BIGINT) AS k, count(*) AS n FROM documented WHERE content IS NOT NULL GROUP BY ALL"""


@query("archive_flow", f"WITH {i.MESSAGES} SELECT event_id, position, topic, CAST({_K} AS BIGINT) AS k, content = '[7]' AS listed FROM documented WHERE content IS NOT NULL")
def archive_flow(spark, sf):
    made = flows.to_archive(i.messages(spark, sf), simple=False)
    return made.filter("error IS NULL").select(
        "event_id", "position", "topic", F.get_json_object("line", "$.k").cast("long").alias("k"), (F.col("line") == "[7]").alias("listed")
    )


def _archived(lines):
    found = lines.select("topic", F.get_json_object("value", "$.k").cast("long").alias("k"), (F.col("value") == "[7]").alias("listed"))
    return found.groupBy("topic", "listed", "k").agg(F.count("*").alias("n"))


@query("sink_archive", f"WITH {i.MESSAGES} {_ARCHIVED}")
def sink_archive(spark, sf):
    out = i.scratch(spark, "archive")
    good, _ = envelope.split_errors(flows.to_archive(i.messages(spark, sf), simple=False))
    tables.write_archive(good, out)
    return _archived(spark.read.text(out))


@query("stream_archive", f"WITH {i.MESSAGES} {_ARCHIVED}")
def stream_archive(spark, sf):
    out = i.scratch(spark, "stream-archive")
    streaming.archive_stream(i.messages(i.event_stream(spark, sf)), f"{out}/lines", f"{out}/checkpoint", simple=False).awaitTermination()
    return _archived(spark.read.text(f"{out}/lines"))


@query(
    "stream_archive_failures",
    f"""WITH {i.MESSAGES}, every AS (
      SELECT topic, CASE WHEN content IS NULL THEN 'Timber Content Missing Error' END AS error FROM documented
      UNION ALL SELECT topic, 'Protobuf Parse Error' FROM logs WHERE event_id % 10 = 9)
    SELECT topic, error, count(*) AS n FROM every GROUP BY ALL""",
)
def stream_archive_failures(spark, sf):
    """Every record of the stream is in the archive or in the dead-letter table."""
    out = i.scratch(spark, "stream-archive")
    streaming.archive_stream(
        i.messages(i.event_stream(spark, sf)), f"{out}/lines", f"{out}/checkpoint", simple=False, dead_letters=f"{out}/dead"
    ).awaitTermination()
    lines = spark.read.text(f"{out}/lines").select("topic", F.lit(None).cast("string").alias("error"))
    dead = spark.read.parquet(f"{out}/dead").select("topic", "error")
    return lines.unionByName(dead).groupBy("topic", "error").agg(F.count("*").alias("n"))


# Every topic once with the options of its first record, over a stream that ran, was fed again and replayed.
@query(
    "stream_topic_registry",
    f"""WITH {i.LOGS} SELECT topic, CAST(1 + arg_min(event_id, (ts, event_id)) % 3 AS INTEGER) AS partitions,
    CAST(1 + arg_min(event_id, (ts, event_id)) % 2 AS INTEGER) AS replication, CAST(0 AS BIGINT) AS batch_id FROM logs GROUP BY topic""",
)
def stream_topic_registry(spark, sf):
    out = i.scratch(spark, "topic-registry")
    logs = i.from_events(i.event_stream(spark, sf))
    registry.registry_stream(logs, f"{out}/topics", f"{out}/checkpoint", ["ts", "event_id"]).awaitTermination()
    again = i.logs(spark, sf)
    registry.register_topics(again, f"{out}/topics", 0, ["ts", "event_id"])
    registry.register_topics(again, f"{out}/topics", 1, ["ts", "event_id"])
    return registry.read_registry(spark, f"{out}/topics")


@query(
    "stream_archive_flushes",
    f"""WITH {i.MESSAGES} SELECT topic, 'success' AS outcome, count(*) AS lines FROM documented WHERE content IS NOT NULL GROUP BY topic
    UNION ALL
    SELECT topic, 'dead letter', count(*) FROM (SELECT topic FROM documented WHERE content IS NULL UNION ALL SELECT topic FROM logs WHERE event_id % 10 = 9) GROUP BY topic""",
)
def stream_archive_flushes(spark, sf):
    """A stream archived flush by flush; what failed is beside it without being asked for."""
    out = i.scratch(spark, "archive-flushes")
    messages = i.messages(i.event_stream(spark, sf))
    streaming.archive_stream(messages, f"{out}/lines", f"{out}/checkpoint", simple=False, flush_bytes=20_000, flush_seconds=86_400).awaitTermination()
    lines = flushes.read_archive(spark, f"{out}/lines").select("topic", F.lit("success").alias("outcome"))
    dead = spark.read.parquet(f"{out}/lines/_dead_letters").select("topic", F.lit("dead letter").alias("outcome"))
    return lines.unionByName(dead).groupBy("topic", "outcome").agg(F.count("*").alias("lines"))


@query(
    "stream_index_counters",
    f"""WITH {i.MESSAGES} SELECT count(*) + (SELECT count(*) FROM logs WHERE event_id % 10 = 9) AS records, CAST(count_if(error IS NULL) AS BIGINT) AS stored,
    CAST(count_if(error IS NOT NULL) + (SELECT count(*) FROM logs WHERE event_id % 10 = 9) AS BIGINT) AS failed FROM documented""",
)
def stream_index_counters(spark, sf):
    """What an index stream counted in the pass that wrote the index."""
    out = i.scratch(spark, "counters")
    streaming.index_stream(
        i.messages(i.event_stream(spark, sf)), f"{out}/index", f"{out}/dead", f"{out}/checkpoint", INDEX_RULES, clock=F.col("ts"),
        hooks=streaming.Hooks(counters=f"{out}/counters"),
    ).awaitTermination()
    return spark.read.parquet(f"{out}/counters").agg(*[F.sum(c).alias(c) for c in ("records", "stored", "failed")])


@query("sink_data_stream", f"WITH {i.MESSAGES} SELECT es_index_prefix AS stream, count(*) AS n FROM documented WHERE error IS NULL GROUP BY ALL")
def sink_data_stream(spark, sf):
    """Documents appended to data streams, which have no day in their names."""
    out = i.scratch(spark, "data-stream")
    streaming.index_stream(
        i.messages(i.event_stream(spark, sf)), f"{out}/index", f"{out}/dead", f"{out}/checkpoint", INDEX_RULES, clock=F.col("ts"), data_stream=True
    ).awaitTermination()
    return spark.read.parquet(f"{out}/index").groupBy(F.col("index_name").alias("stream")).agg(F.count("*").alias("n"))


# A batch is a user's turns of conversation; its cost is the number of its items.
_PRODUCED = f"""b AS (
  SELECT conv_id, conv_id % 4 AS app, conv_id * 500000 AS at_us, count(*) AS cost, 1 + conv_id % 4 AS max_tps FROM conversations GROUP BY conv_id),
o AS (SELECT *, at_us - at_us % {SECONDS * 1_000_000} AS w, row_number() OVER (PARTITION BY app, w ORDER BY at_us, conv_id) AS rn FROM b),
fold AS (
  SELECT app, w, rn, conv_id, CASE WHEN cost <= max_tps * {SECONDS} THEN max_tps * {SECONDS} - cost ELSE max_tps * {SECONDS} END AS rest,
         cost <= max_tps * {SECONDS} AS admitted FROM o WHERE rn = 1
  UNION ALL
  SELECT o.app, o.w, o.rn, o.conv_id, CASE WHEN o.cost <= f.rest THEN f.rest - o.cost ELSE f.rest END, o.cost <= f.rest
  FROM fold f JOIN o ON o.app = f.app AND o.w = f.w AND o.rn = f.rn + 1)"""


@query(
    "produce_flow",
    f"""WITH RECURSIVE {_PRODUCED}
    SELECT conv_id, 'app' || app || '_logs' AS topic, admitted,
      CASE WHEN admitted THEN (SELECT string_agg(text, '|' ORDER BY turn) FROM conversations c WHERE c.conv_id = fold.conv_id) END AS contents,
      CASE WHEN NOT admitted THEN 'Bandwidth Limit Exceeded' END AS reject_reason
    FROM fold""",
)
def produce_flow(spark, sf):
    turns = i.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.lit("").alias("timestamp"), F.col("text").alias("content")
    )
    batches = envelope.collect_batch(turns, ["conv_id"], "turn").select(
        "conv_id",
        F.timestamp_micros(F.col("conv_id") * 500000).alias("at"),
        F.struct(
            F.concat(F.lit("app"), (F.col("conv_id") % 4).cast("string")).alias("kafka_topic"),
            (1 + F.col("conv_id") % 4).cast("int").alias("app_max_tps"),
            F.lit(False).alias("disable_app_tps"),
            F.lit(0).alias("app_group_max_tps"),
        ).alias("context"),
        "items",
    )
    messages, refused = flows.produce(batches, clock="at", seq="conv_id", window_seconds=SECONDS)
    decoded = envelope.decode(messages.select("conv_id", "topic", "value", "headers"))
    return decoded.select(
        "conv_id", "topic", F.lit(True).alias("admitted"),
        F.array_join(F.transform("items", lambda item: item.getField("content")), "|").alias("contents"),
        F.lit(None).cast("string").alias("reject_reason"),
    ).unionByName(
        refused.select(
            "conv_id", "topic", F.lit(False).alias("admitted"), F.lit(None).cast("string").alias("contents"), "reject_reason"
        )
    )


# The flagship: redact every document by its application's rules and meter the bytes seen and kept.
FLAGSHIP_SQL = f"""SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(strlen(redacted)) AS BIGINT) AS kept,
  count(*) FILTER (redacted <> text) AS changed FROM (SELECT source, text, {BY_APP_SQL} AS redacted FROM documents) GROUP BY source"""


@query("redaction_meter", FLAGSHIP_SQL)
def redaction_meter(spark, sf):
    done = texts(spark, sf).withColumn("redacted", redact_by_app(F.col("source"), F.col("text"), RULES))
    return done.groupBy("source").agg(
        F.sum(F.octet_length("text")).alias("bytes"),
        F.sum(F.octet_length("redacted")).alias("kept"),
        F.count_if(F.col("redacted") != F.col("text")).alias("changed"),
    )
