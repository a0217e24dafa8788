"""Queries: metering."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions.document import app_name, error_class, index_base, index_name
from logloom.operators import meter, quantiles
from logloom.operators.admit import admit, split_rejected
from logloom.operators.envelope import split_errors
from logloom.plans import flows
from logloom.plans import inputs as i
from logloom.plans.limits import ARGS, REFILL, SEGMENT_BYTES, SEGMENT_SECONDS, SEGMENTS, segment_lines
from logloom.plans.records import ERROR_SQL, error_reason
from logloom.plans.redaction import RULES
from logloom.plans.registry import query
from logloom.sinks import flushes
from logloom.session import stored
from logloom.sources.rules import rules_table


@query("m_incoming", f"WITH {i.LOGS} SELECT topic, count(*) AS n FROM logs GROUP BY topic")
def m_incoming(spark, sf):
    return meter.count_by(i.logs(spark, sf), "topic")


@query(
    "m_incoming_hourly",
    f"WITH {i.LOGS} SELECT topic, epoch_us(date_trunc('hour', ts)) AS window_us, count(*) AS n FROM logs GROUP BY ALL",
)
def m_incoming_hourly(spark, sf):
    counted = meter.count_by(i.logs(spark, sf), "topic", every="1 hour")
    return counted.select("topic", F.unix_micros("window_start").alias("window_us"), "n")


_OUTCOME = "CASE event_id % 50 WHEN 0 THEN 'create_topic' WHEN 1 THEN 'send_log' WHEN 2 THEN 'send_create_topic_event' ELSE '' END"


@query("m_produced", f"WITH {i.LOGS} SELECT topic, {_OUTCOME} AS error_type, count(*) AS n FROM logs GROUP BY ALL")
def m_produced(spark, sf):
    return meter.count_by(i.logs(spark, sf).withColumn("error_type", F.expr(_OUTCOME)), "topic", "error_type")


@query("m_bytes", f"WITH {i.REQUESTS} SELECT replace(topic, '_logs', '') AS app_name, CAST(sum(bytes) AS BIGINT) AS bytes FROM requests GROUP BY ALL")
def m_bytes(spark, sf):
    sized = i.requests(spark, sf).withColumn("app_name", app_name(F.col("topic")))
    return meter.sum_by(sized, "bytes", "app_name", name="bytes")


def _refused(spark, sf):
    return split_rejected(admit(i.requests(spark, sf), cost="cost", **ARGS))[1]


_REFUSED = f"WITH RECURSIVE {REFILL}, refused AS (SELECT r.* FROM fold JOIN requests r USING (event_id) WHERE NOT admitted)"


@query("m_refused", f"{_REFUSED} SELECT topic, CAST(sum(cost) AS BIGINT) AS n FROM refused GROUP BY topic")
def m_refused(spark, sf):
    return meter.sum_by(_refused(spark, sf), "cost", "topic", name="n")


@query("m_refused_bytes", f"{_REFUSED} SELECT replace(topic, '_logs', '') AS app_name, CAST(sum(bytes) AS BIGINT) AS bytes FROM refused GROUP BY ALL")
def m_refused_bytes(spark, sf):
    refused = _refused(spark, sf).withColumn("app_name", app_name(F.col("topic")))
    return meter.sum_by(refused, "bytes", "app_name", name="bytes")


@query(
    "m_stored",
    f"""WITH {i.LOGS}, c AS (SELECT es_index_prefix AS index_base, {ERROR_SQL} AS error FROM logs)
    SELECT index_base, CASE WHEN error = '' THEN 'created' ELSE '' END AS result,
    CAST(CASE WHEN error = '' THEN 201 ELSE 400 END AS INTEGER) AS status, error, count(*) AS n FROM c GROUP BY ALL""",
)
def m_stored(spark, sf):
    cause = F.when(F.col("event_id") % 3 == 0, F.lit("caused by no such shard"))
    replies = i.logs(spark, sf).select(
        index_base(index_name(F.col("context.es_index_prefix"), F.col("ts"))).alias("index_base"),
        error_class(error_reason(), cause).alias("error"),
    )
    stored = F.col("error") == ""
    return meter.count_by(
        replies.withColumns(
            {"result": F.when(stored, "created").otherwise(""), "status": F.when(stored, 201).otherwise(400)}
        ),
        "index_base", "result", "status", "error",
    )


@query(
    "m_convert_error",
    f"""WITH {i.MESSAGES} SELECT label, count(*) AS n FROM (
      SELECT es_index_prefix AS label FROM documented WHERE error IS NOT NULL
      UNION ALL SELECT 'no_index' FROM logs WHERE event_id % 10 = 9) GROUP BY label""",
)
def m_convert_error(spark, sf):
    _, failed = split_errors(flows.to_index(i.messages(spark, sf), {}))
    label = F.coalesce(F.col("context.es_index_prefix"), F.lit("no_index"))
    return meter.count_by(failed.select(label.alias("label")), "label")


@query(
    "m_redact_bytes",
    "SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents WHERE source <> 'src1' GROUP BY source",
)
def m_redact_bytes(spark, sf):
    """Bytes seen by redaction: of applications with rules, be they their own or the default ones (src1 has an empty set)."""
    rows = i.table(spark, sf, "documents")
    return meter.redacted_bytes(rows, RULES, "source", "text")


@query(
    "m_rules",
    """SELECT source || '-' || doc_id AS app, type, CAST(CASE WHEN type = 'StaticRules' OR doc_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS rules
    FROM documents, (VALUES ('StaticRules'), ('JsonPathRules')) t(type)""",
)
def m_rules(spark, sf):
    return meter.rule_counts(rules_table(i.rule_texts(spark, sf)))


def _rounded(df):
    return df.withColumn("total", F.round("total", 4))


_QUANTILES = """quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99,
  count(value) AS n, round(sum(value), 4) AS total"""


@query("m_latency_by_topic", f"WITH {i.LOGS} SELECT topic, {_QUANTILES} FROM logs GROUP BY topic")
def m_latency_by_topic(spark, sf):
    return _rounded(meter.latency_by(i.logs(spark, sf), "value", "topic", exact=True))


@query("m_latency", f"SELECT {_QUANTILES} FROM events")
def m_latency(spark, sf):
    return _rounded(meter.latency_by(i.logs(spark, sf), "value", exact=True))


# Hourly sketches, stored, and rolled up to days; an estimate's share of rows below it is off by 1 % at most.
@query("m_latency_rollup", f"WITH {i.LOGS} SELECT topic, epoch_us(date_trunc('day', ts)) AS day_us, count(value) AS n, true AS close FROM logs GROUP BY ALL")
def m_latency_rollup(spark, sf):
    logs = i.logs(spark, sf)
    hours = stored(quantiles.sketches(logs, "value", "topic", every="1 hour"), "sketches")
    days = quantiles.sketched_quantiles(quantiles.merged_sketches(hours, "topic", every="1 day"), (0.5, 0.9, 0.99))
    dated = logs.select("topic", F.date_trunc("day", "ts").alias("window_start"), "value")
    def close(p):
        """Values below the estimate are no more, values up to it no fewer than asked for, but for 1 % and one row."""
        estimate, n = F.col(f"p{p}"), F.count("value")
        slack = F.lit(0.01) * n + 1
        return (F.count_if(F.col("value") < estimate) <= F.lit(p / 100) * n + slack) & (F.count_if(F.col("value") <= estimate) >= F.lit(p / 100) * n - slack)

    shares = [close(p).alias(f"e{p}") for p in (50, 90, 99)]
    checked = dated.join(days, ["topic", "window_start"]).groupBy("topic", "window_start", "n").agg(*shares)
    return checked.select("topic", F.unix_micros("window_start").alias("day_us"), "n", (F.col("e50") & F.col("e90") & F.col("e99")).alias("close"))


@query(
    "m_errors",
    f"""WITH {i.LOGS} SELECT CASE event_id % 5 WHEN 0 THEN 'gcs_buffer_full: ' || topic WHEN 1 THEN 'kafka_admin_refresh_topics'
    WHEN 2 THEN 'spawn_logs_worker_' || topic ELSE 'es_client' END AS operation,
    CASE event_id % 5 WHEN 3 THEN 'init' WHEN 4 THEN 'retry' ELSE '' END AS phase, count(*) AS n FROM logs GROUP BY ALL""",
)
def m_errors(spark, sf):
    n, topic = F.col("event_id"), F.col("topic")
    operation = (
        F.when(n % 5 == 0, F.concat(F.lit("gcs_buffer_full: "), topic))
        .when(n % 5 == 1, F.lit("kafka_admin_refresh_topics"))
        .when(n % 5 == 2, F.concat(F.lit("spawn_logs_worker_"), topic))
        .otherwise(F.lit("es_client"))
    )
    phase = F.when(n % 5 == 3, F.lit("init")).when(n % 5 == 4, F.lit("retry")).otherwise("")
    return meter.count_by(i.logs(spark, sf).withColumns({"operation": operation, "phase": phase}), "operation", "phase")


@query(
    "m_index_created",
    f"""WITH {i.LOGS}, d AS (SELECT es_index_prefix || '-' || strftime(ts, '%Y.%m.%d') AS index_name, max(event_id) AS last FROM logs GROUP BY ALL)
    SELECT CASE WHEN last % 4 = 0 THEN 'fail' ELSE 'success' END AS event, count(*) AS n FROM d GROUP BY ALL""",
)
def m_index_created(spark, sf):
    """Each daily index is created once, when its first document comes."""
    named = i.logs(spark, sf).withColumn("index_name", index_name(F.col("context.es_index_prefix"), F.col("ts")))
    created = named.groupBy("index_name").agg(F.max("event_id").alias("last"))
    return meter.count_by(created.withColumn("event", F.when(F.col("last") % 4 == 0, "fail").otherwise("success")), "event")


@query(
    "m_convert_error_by_topic",
    f"""WITH {i.MESSAGES} SELECT label, count(*) AS n FROM (
      SELECT topic || '_' || error AS label FROM documented WHERE error IS NOT NULL
      UNION ALL SELECT topic || '_Protobuf Parse Error' FROM logs WHERE event_id % 10 = 9) GROUP BY label""",
)
def m_convert_error_by_topic(spark, sf):
    _, failed = split_errors(flows.to_index(i.messages(spark, sf), {}))
    return meter.count_by(failed.select(F.concat_ws("_", "topic", "error").alias("label")), "label")


@query("m_secrets", "SELECT DISTINCT user_id::VARCHAR AS app_secret FROM events")
def m_secrets(spark, sf):
    return meter.secrets_seen(i.logs(spark, sf).select("context.app_secret"))


def _stores(spark, sf):
    return _stores_of(i.logs(spark, sf))


def _stores_of(logs):
    return logs.select("arrival", "context.app_secret", (F.col("event_id") % 9 != 0).alias("ok"))


@query(
    "m_app_usage",
    """SELECT user_id::VARCHAR AS app_secret, count(*) FILTER (event_id % 9 <> 0) AS success, count(*) FILTER (event_id % 9 = 0) AS fail
    FROM events GROUP BY ALL""",
)
def m_app_usage(spark, sf):
    return meter.app_usage(_stores(spark, sf))


def _reports(width: int) -> str:
    return f"""{i.LOGS}, c AS (
      SELECT arrival_us - arrival_us % {width} AS window_us, user_id::VARCHAR AS token, count(*) FILTER (event_id % 9 <> 0) AS new_log_count
      FROM logs GROUP BY ALL),
    reports AS (
      SELECT window_us, CAST(to_json({{'application_groups': list({{'token': token, 'new_log_count': new_log_count}} ORDER BY token)}}) AS VARCHAR) AS report
      FROM c GROUP BY window_us)"""


@query("usage_report", f"WITH {_reports(30_000_000)} SELECT window_us, report FROM reports")
def usage_report(spark, sf):
    return meter.usage_report(_stores(spark, sf), ts="arrival").select(
        F.unix_micros("window_start").alias("window_us"), "report"
    )


@query(
    "usage_report_empty",
    f"""WITH {_reports(100_000)}, every AS (SELECT unnest(generate_series(min(window_us), max(window_us), 100000)) AS window_us FROM reports)
    SELECT window_us, coalesce(report, '{{"application_groups":[]}}') AS report FROM every LEFT JOIN reports USING (window_us)""",
)
def usage_report_empty(spark, sf):
    """Short intervals, so that some have no record."""
    return meter.usage_report(_stores(spark, sf), ts="arrival", every="100 milliseconds", empty=True).select(
        F.unix_micros("window_start").alias("window_us"), "report"
    )


# A stream gives the windows that its watermark has passed: the latest time, in milliseconds, less the lateness.
def _closed(width: int, late: int, time: str) -> str:
    return f"window_us + {width} <= (SELECT max({time}) // 1000 * 1000 FROM logs) - {late}"


@query("stream_usage_report", f"WITH {_reports(30_000_000)} SELECT window_us, report FROM reports WHERE {_closed(30_000_000, 60_000_000, 'arrival_us')}")
def stream_usage_report(spark, sf):
    stores = _stores_of(i.from_events(i.event_stream(spark, sf))).withWatermark("arrival", "1 minute")
    reports = i.drained(spark, meter.usage_report(stores, ts="arrival"), "usage")
    return reports.select(F.unix_micros("window_start").alias("window_us"), "report")


@query(
    "stream_meter",
    f"""WITH {i.LOGS}, c AS (
      SELECT topic, epoch_us(ts) - epoch_us(ts) % 3600000000 AS window_us, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM logs GROUP BY ALL)
    SELECT * FROM c WHERE {_closed(3_600_000_000, 3_600_000_000, "epoch_us(ts)")}""",
)
def stream_meter(spark, sf):
    logs = i.from_events(i.event_stream(spark, sf)).withWatermark("ts", "1 hour")
    summed = i.drained(spark, meter.sum_by(logs, F.octet_length("content"), "topic", name="bytes", every="1 hour"), "meter")
    return summed.select("topic", F.unix_micros("window_start").alias("window_us"), "bytes")


@query("m_tps", f"WITH {i.LOGS} SELECT arrival_us - arrival_us % 1000000 AS window_us, count(*) AS n FROM logs GROUP BY ALL")
def m_tps(spark, sf):
    counted = meter.count_by(i.logs(spark, sf), every="1 second", ts="arrival")
    return counted.select(F.unix_micros("window_start").alias("window_us"), "n")


_FLUSHES = f"""WITH RECURSIVE {SEGMENTS}, s AS (
  SELECT topic, window_us, segment, count(*) AS lines, CAST(sum(o.bytes) AS BIGINT) AS bytes FROM fold JOIN o USING (event_id, topic, window_us) GROUP BY ALL)"""


def _archive(spark, sf):
    """The events' lines, archived flush by flush: (folder, manifest)."""
    out = i.scratch(spark, "flushes")
    return out, flushes.write_flushes(segment_lines(spark, sf), out, seq="event_id", max_bytes=SEGMENT_BYTES, max_seconds=SEGMENT_SECONDS)


@query(
    "m_archive",
    f"{_FLUSHES} SELECT topic, 'success' AS outcome, count(*) AS uploads, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(bytes) AS BIGINT) AS bytes FROM s GROUP BY topic",
)
def m_archive(spark, sf):
    return flushes.uploads(_archive(spark, sf)[1], "topic")


@query("archive_manifest", f"{_FLUSHES} SELECT topic, window_us, segment, lines, bytes, 'success' AS outcome FROM s")
def archive_manifest(spark, sf):
    return _archive(spark, sf)[1].select("topic", F.unix_micros("flush_window").alias("window_us"), "segment", "lines", "bytes", "outcome")


@query(
    "archive_objects",
    f"{_FLUSHES} SELECT topic, lines, bytes, count(*) AS objects FROM s GROUP BY ALL",
)
def archive_objects(spark, sf):
    """What is in the objects, read back through the manifest."""
    out, _ = _archive(spark, sf)
    held = flushes.read_archive(spark, out).groupBy("topic", "object").agg(F.count("*").alias("lines"), F.sum(F.octet_length("value")).alias("bytes"))
    return held.groupBy("topic", "lines", "bytes").agg(F.count("*").alias("objects"))


@query(
    "m_buffer",
    f"""WITH {i.REQUESTS} SELECT r.topic, CAST(arg_max(r.bytes, (l.ts, r.event_id)) AS INTEGER) AS bytes, 1 AS info
    FROM requests r JOIN logs l USING (event_id) GROUP BY ALL""",
)
def m_buffer(spark, sf):
    sized = i.logs(spark, sf).withColumn("bytes", F.octet_length(F.to_json(F.struct("topic", "timestamp", "content"))))
    return meter.with_info(meter.last_value(sized, "bytes", "topic", seq="event_id"))
