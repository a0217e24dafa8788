"""Queries: sources, envelopes, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import document as d
from logloom.operators import documents, envelope, topics
from logloom.plans import flows
from logloom.plans import inputs as i
from logloom.plans.registry import query
from logloom.session import spread
from logloom.sinks import tables
from logloom.sources.logs import scan_messages
from logloom.sources.rules import rules_table


@query("log_scan", f"WITH {i.LOGS} SELECT event_id, topic, stamp AS log_time, props AS content FROM logs")
def log_scan(spark, sf):
    return i.logs(spark, sf).select("event_id", "topic", F.col("timestamp").alias("log_time"), "content")


def _written(spark, sf):
    """The events' records as messages in folders by topic."""
    out = i.scratch(spark, "scan")
    headers = F.array().cast("array<struct<key:string,value:binary>>").alias("headers")
    tables.write_topics(i.logs(spark, sf).select("topic", F.col("event_id").cast("string").alias("value"), headers), out)
    return out


@query("scan_prefix", f"WITH {i.LOGS} SELECT event_id, topic FROM logs WHERE starts_with(topic, 'app_v')")
def scan_prefix(spark, sf):
    """Topics announced later are chosen by their prefix alone; only their folders are opened."""
    found = scan_messages(spark, _written(spark, sf), format="parquet", prefix="app_v")
    return found.select(F.col("value").cast("long").alias("event_id"), "topic")


@query("scan_registered", f"WITH {i.LOGS} SELECT event_id, topic FROM logs WHERE event_type IN ('error', 'click')")
def scan_registered(spark, sf):
    """Topics of a table, found while the query runs."""
    chosen = i.logs(spark, sf).filter(F.col("context.kafka_topic").isin("error", "click")).select("topic").distinct()
    found = scan_messages(spark, _written(spark, sf), format="parquet", topics=chosen)
    return found.select(F.col("value").cast("long").alias("event_id"), "topic")


@query("topic_prefix_suffix", f"WITH {i.LOGS} SELECT event_id, topic FROM logs WHERE starts_with(topic, 'app_') AND ends_with(topic, 'w_logs')")
def topic_prefix_suffix(spark, sf):
    return i.logs(spark, sf).filter(topics.matches_affixes(F.col("topic"), "app_", "w_logs")).select("event_id", "topic")


@query("topic_regex", f"WITH {i.LOGS} SELECT event_id, topic FROM logs WHERE regexp_matches(topic, 'p_(view|err)')")
def topic_regex(spark, sf):
    return i.logs(spark, sf).filter(topics.matches_pattern(F.col("topic"), "p_(view|err)")).select("event_id", "topic")


@query("new_topics", f"WITH {i.REGISTRY} SELECT DISTINCT topic FROM doc_logs WHERE topic NOT IN (SELECT topic FROM registry)")
def new_topics(spark, sf):
    return topics.new_topics(i.document_logs(spark, sf), i.toxic_topics(spark, sf))


@query(
    "topic_events",
    f"""WITH {i.REGISTRY}
    SELECT topic, CAST(1 + min(doc_id) % 3 AS INTEGER) AS partitions, CAST(1 + min(doc_id) % 2 AS INTEGER) AS replication
    FROM doc_logs WHERE topic NOT IN (SELECT topic FROM registry) GROUP BY topic""",
)
def topic_events(spark, sf):
    return topics.topic_events(i.document_logs(spark, sf), i.toxic_topics(spark, sf), ["doc_id"])


@query(
    "rules_load",
    r"""SELECT source || '-' || doc_id AS app, upper(lang) AS name, '[a-z]+@' || source || '\.com' AS regex,
    CAST(doc_id % 4 AS INTEGER) AS keep_start, CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS path_rules
    FROM documents""",
)
def rules_load(spark, sf):
    first = F.col("StaticRules")[0]
    return rules_table(i.rule_texts(spark, sf)).select(
        "app",
        first.getField("Name").alias("name"),
        first.getField("Regex").alias("regex"),
        first.getField("HintCharsStart").alias("keep_start"),
        F.size("JsonPathRules").alias("path_rules"),
    )


@query("format_dispatch", "SELECT event_id, event_id % 3 = 0 AS is_collection FROM events")
def format_dispatch(spark, sf):
    return i.messages(spark, sf).select("event_id", envelope.is_collection(F.col("headers")).alias("is_collection"))


@query(
    "envelope_decode",
    """SELECT event_id, CASE WHEN event_id % 10 = 9 THEN 'Protobuf Parse Error' END AS error,
    CASE WHEN event_id % 10 <> 9 THEN 'idx_' || event_type END AS es_index_prefix,
    CASE WHEN event_id % 10 <> 9 THEN user_id::VARCHAR END AS app_secret,
    CAST(CASE WHEN event_id % 10 = 9 THEN NULL WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n_items FROM events""",
)
def envelope_decode(spark, sf):
    return envelope.decode(i.messages(spark, sf)).select(
        "event_id", "error", "context.es_index_prefix", "context.app_secret",
        F.when(F.col("error").isNull(), F.size("items")).alias("n_items"),
    )


@query(
    "explode_batch",
    f"WITH {i.MESSAGES} SELECT event_id, position, event_type AS kafka_topic, stamp AS timestamp, content FROM items",
)
def explode_batch(spark, sf):
    decoded, _ = envelope.split_errors(envelope.decode(i.messages(spark, sf)))
    return envelope.explode_batch(decoded).select(
        "event_id", "position", "context.kafka_topic", "timestamp", "content"
    )


@query(
    "wrap_single",
    f"WITH {i.LOGS} SELECT event_id, event_type AS kafka_topic, CAST(1 AS INTEGER) AS n_items, stamp AS timestamp, props AS content FROM logs",
)
def wrap_single(spark, sf):
    return envelope.wrap_single(i.logs(spark, sf)).select(
        "event_id", "context.kafka_topic", F.size("items").alias("n_items"),
        F.col("items")[0].getField("timestamp").alias("timestamp"), F.col("items")[0].getField("content").alias("content"),
    )


@query(
    "collect_batch",
    "SELECT conv_id, CAST(count(*) AS INTEGER) AS n_items, string_agg(role || ':' || text, '|' ORDER BY turn) AS contents FROM conversations GROUP BY conv_id",
)
def collect_batch(spark, sf):
    turns = i.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.lit("").alias("timestamp"), F.concat_ws(":", "role", "text").alias("content")
    )
    return envelope.collect_batch(turns, ["conv_id"], "turn").select(
        "conv_id", F.size("items").alias("n_items"),
        F.array_join(F.transform("items", lambda item: item.getField("content")), "|").alias("contents"),
    )


@query(
    "dead_letter",
    f"""WITH {i.MESSAGES} SELECT event_id, position, error FROM documented WHERE error IS NOT NULL
    UNION ALL SELECT event_id, NULL, 'Protobuf Parse Error' FROM logs WHERE event_id % 10 = 9""",
)
def dead_letter(spark, sf):
    made = flows.to_index(i.messages(spark, sf), {})
    return envelope.split_errors(made)[1].select("event_id", "position", "error")


@query("topic_name", "SELECT event_id, 'pre_' || event_type || '_logs' AS topic FROM events")
def topic_name(spark, sf):
    return i.table(spark, sf, "events").select("event_id", d.topic_name(F.col("event_type"), "pre_").alias("topic"))


@query("ingest_stamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def ingest_stamp(spark, sf):
    return i.logs(spark, sf).select("event_id", d.ingest_stamp(F.col("ts")).alias("stamp"))


@query(
    "rate_key",
    f"""WITH {i.REQUESTS} SELECT event_id, 'flow:' || key AS key, CAST(max_tps AS INTEGER) AS max_tps FROM requests""",
)
def rate_key(spark, sf):
    bucket = d.rate_key(F.col("context"), F.col("topic"), key_prefix=" flow ")
    return i.logs(spark, sf).select("event_id", bucket.alias("b")).select("event_id", "b.key", "b.max_tps")


@query(
    "topic_options",
    """SELECT event_id, CAST(1 + event_id % 3 AS INTEGER) AS partitions, CAST(1 + event_id % 2 AS INTEGER) AS replication,
    CAST(-1 AS INTEGER) AS ignored FROM events""",
)
def topic_options(spark, sf):
    asked, ignored = d.topic_options(F.col("context")), d.topic_options(F.col("context"), ignore=True)
    return i.logs(spark, sf).select("event_id", asked.alias("o"), ignored.getField("partitions").alias("ignored")).select(
        "event_id", "o.partitions", "o.replication", "ignored"
    )


@query(
    "index_route",
    f"""WITH {i.LOGS} SELECT event_id, es_index_prefix || '-' || strftime(ts, '%Y.%m.%d') AS daily, es_index_prefix AS stream FROM logs""",
)
def index_route(spark, sf):
    prefix = F.col("context.es_index_prefix")
    return i.logs(spark, sf).select(
        "event_id", d.index_name(prefix, F.col("ts")).alias("daily"), d.index_name(prefix, F.col("ts"), True).alias("stream")
    )


@query(
    "search_document",
    f"""WITH {i.LOGS} SELECT event_id,
      CASE WHEN event_id % 6 >= 4 THEN NULL ELSE CASE event_id % 4 WHEN 0 THEN 'given' WHEN 3 THEN NULL ELSE stamp END END AS at_timestamp,
      CASE WHEN event_id % 6 >= 4 OR event_id % 4 = 2 THEN NULL ELSE json_extract(props, '$.k')::VARCHAR END AS k,
      CASE event_id % 6 WHEN 4 THEN 'Timber Content Missing Error' WHEN 5 THEN 'JSON Parse Error' END AS error
    FROM logs""",
)
def search_document(spark, sf):
    n, k = F.col("event_id"), F.get_json_object("content", "$.k")
    content = (
        F.when(n % 6 == 4, F.lit(None))
        .when(n % 6 == 5, F.concat(F.lit('{"broken": '), k))
        .when(n % 4 == 0, F.concat(F.lit('{"k": '), k, F.lit(', "@timestamp": "given"}')))
        .when(n % 4 == 2, F.lit("{}"))
        .when(n % 4 == 3, F.concat(F.lit('{"@timestamp": null, "k": '), k, F.lit("}")))
        .otherwise(F.col("content"))
    )
    made = documents.search_documents(spread(i.logs(spark, sf)).select("event_id", "timestamp", content.alias("content")))
    return made.select(
        "event_id",
        F.get_json_object("document", "$['@timestamp']").alias("at_timestamp"),
        F.get_json_object("document", "$.k").alias("k"),
        "error",
    )


def _archive_content():
    n = F.col("doc_id")
    message = (
        F.when(n % 7 == 1, F.to_json(F.struct("lang", "n_chars")))
        .when(n % 7 == 2, F.lit(""))
        .when(n % 7 == 3, F.concat(F.lit("[1, "), F.col("lang")))
        .otherwise(F.concat(F.lit("> "), F.col("text")))
    )
    container = F.when(n % 7 != 4, F.struct(F.col("source").alias("container_name")))
    return F.to_json(
        F.struct(message.alias("@message"), container.alias("k8s_metadata"), F.when(n % 7 != 5, F.col("lang")).alias("@timestamp"))
    )


@query(
    "archive_line",
    """SELECT doc_id,
      CASE doc_id % 7 WHEN 2 THEN 'Timber Field Missing Error' WHEN 4 THEN 'Timber Field Missing Error' WHEN 3 THEN 'JSON Parse Error' END AS error,
      CASE WHEN doc_id % 7 NOT IN (2, 3, 4) THEN source END AS log_tag,
      CASE WHEN doc_id % 7 NOT IN (2, 3, 4) THEN CASE WHEN doc_id % 7 = 5 THEN '' ELSE lang END END AS log_time,
      CASE WHEN doc_id % 7 NOT IN (1, 2, 3, 4) THEN '> ' || text END AS message,
      CASE WHEN doc_id % 7 = 1 THEN n_chars END AS embedded_chars
    FROM documents""",
)
def archive_line(spark, sf):
    made = documents.archive_lines(
        spread(i.table(spark, sf, "documents")).select("doc_id", _archive_content().alias("content"))
    )
    return made.select(
        "doc_id",
        "error",
        F.get_json_object("line", "$.log_tag").alias("log_tag"),
        F.get_json_object("line", "$.log_time").alias("log_time"),
        F.when(F.col("doc_id") % 7 != 1, F.get_json_object("line", "$.message")).alias("message"),
        F.get_json_object("line", "$.message.n_chars").cast("long").alias("embedded_chars"),
    )


@query(
    "archive_full_line",
    "SELECT doc_id, text, lang, CAST(NULL AS VARCHAR) AS error FROM documents",
)
def archive_full_line(spark, sf):
    contents = spread(i.table(spark, sf, "documents")).select("doc_id", F.to_json(F.struct("text", "lang")).alias("content"))
    return documents.archive_lines(contents, simple=False).select(
        "doc_id", F.get_json_object("line", "$.text").alias("text"), F.get_json_object("line", "$.lang").alias("lang"), "error"
    )


@query("app_name", f"WITH {i.LOGS} SELECT event_id, 'app_' || event_type AS app_name FROM logs")
def app_name(spark, sf):
    return i.logs(spark, sf).select("event_id", d.app_name(F.col("topic"), "_lo.s").alias("app_name"))


@query("index_base", f"WITH {i.LOGS} SELECT event_id, es_index_prefix AS index_base FROM logs")
def index_base(spark, sf):
    index = d.index_name(F.col("context.es_index_prefix"), F.col("ts"))
    return i.logs(spark, sf).select("event_id", d.index_base(index).alias("index_base"))


def error_reason():
    """A write error for each event: every known text, an unknown one, and none."""
    texts = [F.concat(F.lit(f"failed: {needle} of "), F.col("context.es_index_prefix")) for needle in d.ERROR_CLASSES]
    reasons = F.array(*texts, F.lit("something else"), F.lit(""))
    return F.element_at(reasons, (F.col("event_id") % 14 + 1).cast("int"))


ERROR_SQL = """list_element(['multiple_type', 'mapping_failed', 'mapping_failed', 'mapping_failed', 'data_too_large',
  'request_error_transport_service_closed', 'node_not_connected', 'inactive_primary_shard', 'no_such_shard',
  'index_read_only', 'limit_of_total_fields_excedeed', 'maximum_shards_open',
  CASE WHEN event_id % 3 = 0 THEN 'no_such_shard' ELSE 'undefined_error' END, ''], CAST(event_id % 14 + 1 AS BIGINT))"""


@query("error_class", f"SELECT event_id, {ERROR_SQL} AS error_class FROM events")
def error_class(spark, sf):
    cause = F.when(F.col("event_id") % 3 == 0, F.lit("caused by no such shard"))
    return i.logs(spark, sf).select("event_id", d.error_class(error_reason(), cause).alias("error_class"))


@query("log_bytes", f"WITH {i.REQUESTS} SELECT event_id, CAST(bytes AS INTEGER) AS bytes FROM requests")
def log_bytes(spark, sf):
    return i.requests(spark, sf).select("event_id", "bytes")


@query(
    "archive_path",
    f"""WITH {i.LOGS} SELECT event_id, '/bar/' || topic || '/' || topic || '-' || stamp || '.log.gz' AS path FROM logs""",
)
def archive_path(spark, sf):
    return i.logs(spark, sf).select("event_id", d.archive_path("/bar", F.col("topic"), F.col("ts"), "gzip").alias("path"))
