"""Log sources: topic messages from files or from a message broker, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.topics import matches_affixes, matches_pattern
from logloom.schema import MESSAGE


def scan_messages(
    spark: SparkSession, path: str, *, stream: bool = False, format: str = "json", schema=MESSAGE,
    prefix: str | None = None, suffix: str | None = None, pattern: str | None = None, topics: DataFrame | None = None, **options
) -> DataFrame:
    """Messages from a folder, of the topics asked for: by prefix, suffix, unanchored pattern, or a table of topics.

    Where the folder is partitioned by topic, as ``write_topics`` leaves it, the tests are partition filters: the
    folders of other topics are not opened. A table of topics prunes while the query runs.
    """
    reader = spark.readStream if stream else spark.read
    messages = reader.schema(schema).options(**options).format(format).load(path)
    topic = F.col("topic")
    if prefix is not None or suffix is not None:
        messages = messages.filter(matches_affixes(topic, prefix or "", suffix))
    if pattern is not None:
        messages = messages.filter(matches_pattern(topic, pattern))
    if topics is not None:
        messages = messages.join(topics.select("topic").distinct(), "topic", "left_semi")
    return messages


def split_list(text: str) -> list[str]:
    """Names in a comma-separated setting; blanks around them and empty names do not count."""
    return [part.strip() for part in text.split(",") if part.strip()]


def kafka_options(
    *, servers: str, pattern: str | None = None, prefix: str = "", suffix: str = "", group: str | None = None,
    topic: str | None = None, from_oldest: bool = False, max_per_trigger: int | None = None, archive: bool = False,
) -> dict[str, str]:
    """Reader options for a broker: subscription, start offset, group naming and back-pressure.

    A subscription pattern must match the whole topic name, so an unanchored pattern is wrapped.
    Partitions that appear later always start at their oldest offset. ``servers`` may be a list with blanks.
    """
    if topic is not None:
        options = {"subscribe": topic}
    elif pattern is not None:
        options = {"subscribePattern": f".*(?:{pattern}).*"}
    else:
        options = {"subscribePattern": f"{_quote(prefix)}.*{_quote(suffix)}"}
    options["kafka.bootstrap.servers"] = ",".join(split_list(servers))
    options["startingOffsets"] = "earliest" if from_oldest else "latest"
    options["includeHeaders"] = "true"
    if group:
        joint = "" if archive else "_"  # an archive's group is prefix and topic without anything between
        options["groupIdPrefix"] = f"{group}{joint}{topic}" if topic else group
    if max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return options


def _quote(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "_" else c for c in text)


def kafka_messages(spark: SparkSession, options: dict[str, str], *, stream: bool = True) -> DataFrame:
    """Messages from a broker; needs the Kafka connector on the class path."""
    reader = spark.readStream if stream else spark.read
    return (
        reader.format("kafka").options(**options).load()
        .select("topic", F.col("value").cast("string").alias("value"), "headers", "timestamp")
    )
