"""The three log flows, composed from operators; each is one lazy plan, in batch or on a stream."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.document import index_name, ingest_stamp, rate_key, topic_name
from logloom.functions.redact import RuleSet, redact_by_app
from logloom.operators.admit import admit, split_rejected
from logloom.operators.discover import discover
from logloom.operators.documents import archive_lines, search_documents
from logloom.operators.envelope import decode, encode_collection, explode_batch
from logloom.operators.ruletable import RuleTable, redact_by_table


def routed(envelopes: DataFrame, prefix: str = "", suffix: str = "_logs") -> DataFrame:
    """Add ``topic``, and the ``key`` and ``max_tps`` of the rate-limit bucket."""
    topic = topic_name(F.col("context.kafka_topic"), prefix, suffix)
    bucket = rate_key(F.col("context"), F.col("topic"))
    return envelopes.withColumn("topic", topic).select("*", bucket.alias("_bucket")).select("*", "_bucket.*").drop("_bucket")


def produce(
    batches: DataFrame, *, clock: str = "ts", seq: str = "seq", prefix: str = "", suffix: str = "_logs", **limits
) -> tuple[DataFrame, DataFrame]:
    """Route, admit, stamp and encode batches: (messages to write, refused batches)."""
    sized = routed(batches, prefix, suffix).withColumn("cost", F.size("items"))
    admitted, rejected = split_rejected(admit(sized, ts=clock, seq=seq, cost="cost", **limits))
    stamp = ingest_stamp(F.col(clock))
    stamped = admitted.withColumn(
        "items", F.transform("items", lambda i: F.struct(stamp.alias("timestamp"), i.getField("content").alias("content")))
    )
    return encode_collection(stamped), rejected


def to_index(
    messages: DataFrame,
    rules: Mapping[str, RuleSet] | RuleTable | Callable[[Column, Column], Column],
    clock: Column | None = None,
    *,
    data_stream: bool = False,
    content_schema=None,
) -> DataFrame:
    """Decode, route, make search documents and redact them; failures carry ``error``.

    ``rules`` is a mapping, a rule table (many applications), or any function of the application and the
    text to a text, both columns. With ``content_schema="discover"`` the shape of the documents is found
    first, by a job over ``messages``, and path rules stay in built-in expressions but for misfits.
    """
    prefix = F.col("context.es_index_prefix")
    when = F.current_timestamp() if clock is None else clock
    made = _merged(search_documents(_records(messages)))
    named = made.withColumn("index_name", F.when(F.col("error").isNull(), index_name(prefix, when, data_stream)))
    if isinstance(rules, RuleTable):
        return redact_by_table(named.withColumn("_app", prefix), rules, "_app", "document").drop("_app")
    if callable(rules):
        return named.withColumn("document", rules(prefix, F.col("document")))
    if content_schema == "discover":
        by_path = isinstance(rules, Mapping) and any(rule_set.paths for rule_set in rules.values())
        content_schema = discover(named, "document") if by_path else None
    return named.withColumn("document", redact_by_app(prefix, F.col("document"), rules, content_schema))


def to_archive(messages: DataFrame, *, simple: bool = True) -> DataFrame:
    """Decode and make archive lines; failures carry ``error``."""
    return _merged(archive_lines(_records(messages), simple=simple))


def _records(messages: DataFrame) -> DataFrame:
    """One row per record, and one per unreadable message."""
    return explode_batch(decode(messages), keep_unreadable=True).withColumnRenamed("error", "_unread")


def _merged(made: DataFrame) -> DataFrame:
    made = made.withColumn("error", F.coalesce("_unread", "error"))
    # a failed row keeps its message, for a dead letter that can be replayed
    failed = {c: F.when(F.col("error").isNotNull(), F.col(c)) for c in ("value", "headers")}
    return made.withColumns(failed).drop("_unread", "content", "timestamp")
