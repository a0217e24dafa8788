"""Topic selection and discovery on a column of topic names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.document import topic_options
from logloom.functions.regex import to_java_regex
from logloom.session import stored


def matches_affixes(topic: Column, prefix: str, suffix: str | None = None) -> Column:
    """Prefix and suffix test; topics announced later are tested by prefix only (suffix None)."""
    test = topic.startswith(prefix)
    return test if suffix is None else test & topic.endswith(suffix)


def matches_pattern(topic: Column, pattern: str) -> Column:
    """Unanchored regex test."""
    return topic.rlike(to_java_regex(pattern))


def new_topics(logs: DataFrame, registry: DataFrame, topic: str = "topic") -> DataFrame:
    """Topics seen in the logs but absent from the registry."""
    return logs.select(topic).distinct().join(registry.select(topic).distinct(), topic, "left_anti")


def topic_events(
    logs: DataFrame, registry: DataFrame, order: list[str], ignore_options: bool = False
) -> DataFrame:
    """One creation event per unseen topic, with the options of its first record.

    The first value of the leading ``order`` column is found by a hash aggregation, combined before the
    shuffle, which holds a value a topic. Only unseen topics' records that have it are then compared by
    the other columns: records are neither shuffled by topic nor sorted whole.
    """
    options = topic_options(F.col("context"), ignore_options).alias("options")
    lead = F.col(order[0]) if order else F.lit(0)
    # nulls come first, as in the order of structs
    earliest = logs.groupBy("topic").agg(F.when(F.count_if(lead.isNull()) == 0, F.min(lead)).alias("_lead"))
    unseen = earliest.join(registry.select("topic").distinct(), "topic", "left_anti").withColumnRenamed("topic", "_topic")
    first = (
        logs.join(stored(unseen, "unseen"), (F.col("topic") == F.col("_topic")) & lead.eqNullSafe(F.col("_lead")))
        .select("topic", F.struct(*order, options).alias("record"))
        .groupBy("topic")
        .agg(F.min("record").alias("first"))
    )
    return first.select("topic", "first.options.partitions", "first.options.replication")
