"""Metering: counters, byte sums, latency summaries and usage reports by label.

Every measure is a plain aggregate, so Spark combines it before the shuffle and a hot label costs
one row per task. All work on a stream as well when ``every`` gives a tumbling window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.redact import DEFAULT_APP

from logloom.operators.quantiles import exact_quantiles

QUANTILES = (0.5, 0.9, 0.99)


def _grouped(df: DataFrame, labels: list[str], every: str | None, ts: str, *measures: Column) -> DataFrame:
    """Measures by label and, with ``every``, by window. A stream with a watermark is grouped by the
    window itself, which tells Spark when a group is complete."""
    if not every:
        return df.groupBy(*labels).agg(*measures)
    made = df.groupBy(*labels, F.window(ts, every).alias("_w")).agg(*measures)
    rest = [c for c in made.columns if c not in labels and c != "_w"]
    return made.select(*labels, F.col("_w.start").alias("window_start"), *rest)


def count_by(df: DataFrame, *labels: str, name: str = "n", every: str | None = None, ts: str = "ts") -> DataFrame:
    """Events per label (messages read or stored, documents, errors, throughput)."""
    return _grouped(df, list(labels), every, ts, F.count("*").alias(name))


def sum_by(
    df: DataFrame, amount: str | Column, *labels: str, name: str = "total", every: str | None = None, ts: str = "ts"
) -> DataFrame:
    """Sum of an amount per label (bytes ingested, refused records or bytes)."""
    value = F.col(amount) if isinstance(amount, str) else amount
    return _grouped(df, list(labels), every, ts, F.sum(value).alias(name))


def latency_by(
    df: DataFrame, value: str, *labels: str, exact: bool = False, accuracy: int = 10_000, every: str | None = None, ts: str = "ts"
) -> DataFrame:
    """Quantiles, count and sum. The default sketch has a rank error of ``1 / accuracy``, merges and
    works on a stream; ``exact`` (batch only) finds the very value at each quantile's rank."""
    if exact:
        if every:
            df = df.withColumn("window_start", F.window(ts, every).start)
        return exact_quantiles(df, value, [*labels, "window_start"] if every else list(labels), QUANTILES, accuracy)
    quantiles = F.percentile_approx(value, list(QUANTILES), accuracy)
    return (
        _grouped(df, list(labels), every, ts, quantiles.alias("_q"), F.count(value).alias("n"), F.sum(value).alias("total"))
        .select("*", *[F.col("_q")[i].alias(f"p{round(q * 100)}") for i, q in enumerate(QUANTILES)])
        .drop("_q")
    )


def app_usage(df: DataFrame, secret: str = "app_secret", ok: str = "ok", every: str | None = None, ts: str = "ts") -> DataFrame:
    """Records stored and failed per application secret."""
    return _grouped(df, [secret], every, ts, F.count_if(F.col(ok)).alias("success"), F.count_if(~F.col(ok)).alias("fail"))


def usage_report(
    df: DataFrame, secret: str = "app_secret", ok: str = "ok", every: str = "30 seconds", ts: str = "ts", empty: bool = False
) -> DataFrame:
    """One JSON report per interval: new records per application secret.

    Counting comes first, so a report gathers one entry per application, never log rows. With ``empty``
    (batch only) the intervals without records between the first and the last report too.
    """
    counted = df.groupBy(secret, F.window(ts, every).alias("_w")).agg(F.count_if(F.col(ok)).alias("new_log_count"))
    entry = F.struct(F.col(secret).alias("token"), "new_log_count")
    groups = F.array_sort(F.collect_list(entry)).alias("application_groups")
    reports = (
        counted.groupBy(F.window(F.window_time("_w"), every).alias("_v")).agg(F.to_json(F.struct(groups)).alias("report"))
        .select(F.col("_v.start").alias("window_start"), "report")
    )
    if not empty:
        return reports
    ends = df.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).select(F.explode(F.array("a", "b")).alias("t"))
    starts = ends.select(F.window("t", every).start.alias("t")).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    intervals = starts.select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {every}"))).alias("window_start"))
    nothing = F.lit('{"application_groups":[]}')
    return intervals.join(reports, "window_start", "left").withColumn("report", F.coalesce("report", nothing))


def secrets_seen(df: DataFrame, secret: str = "app_secret") -> DataFrame:
    return df.select(secret).distinct()


def last_value(df: DataFrame, value: str, *labels: str, ts: str = "ts", seq: str | None = None) -> DataFrame:
    """Gauge: the latest value per label; of equal times the one with the largest ``seq``, else the largest value."""
    return df.groupBy(*labels).agg(F.max_by(value, F.struct(ts, seq or value)).alias(value))


def with_info(gauges: DataFrame, name: str = "info") -> DataFrame:
    """An info gauge beside the others: 1 for every label set that exists."""
    return gauges.withColumn(name, F.lit(1))


def redacted_bytes(df: DataFrame, rules, app: str, text: str) -> DataFrame:
    """Bytes seen by redaction per application: only of those for which there are rules, their own or the default ones."""
    sets = {name: bool(r.static or r.paths) for name, r in rules.items()}
    default = sets.pop(DEFAULT_APP, False)
    own = F.col(app)
    without, with_rules = [n for n, any_ in sets.items() if not any_], [n for n, any_ in sets.items() if any_]
    seen = ~F.coalesce(own.isin(without), F.lit(False)) if default else F.coalesce(own.isin(with_rules), F.lit(False))
    return sum_by(df.filter(seen), F.octet_length(text), app, name="bytes")


def archive_uploads(segmented: DataFrame, *labels: str, size: str = "bytes") -> DataFrame:
    """Flushes and their uncompressed bytes per label, from lines with ``flush_window`` and ``segment``."""
    flushed = segmented.groupBy(*labels, "flush_window", "segment").agg(F.sum(size).alias("_bytes"))
    return flushed.groupBy(*labels).agg(F.count("*").alias("uploads"), F.sum("_bytes").alias("bytes"))


def rule_counts(rules: DataFrame) -> DataFrame:
    """Number of rules per application and rule type."""
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    return rules.select(
        "app",
        F.inline(
            F.array(
                F.struct(F.lit("StaticRules").alias("type"), size("StaticRules").alias("rules")),
                F.struct(F.lit("JsonPathRules").alias("type"), size("JsonPathRules").alias("rules")),
            )
        ),
    )
