"""Sinks: topic messages, daily indexes and data streams, compressed archives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Codecs the text sink can write.
TEXT_CODECS = ("", "gzip", "lz4", "bzip2", "deflate", "snappy")


def balanced(df: DataFrame, *columns: str) -> DataFrame:
    """Cluster by partition value for few, even files; AQE splits a value that holds too much."""
    return df.hint("rebalance", *columns)


def write_topics(messages: DataFrame, path: str, mode: str = "append") -> None:
    """Messages as files partitioned by topic."""
    rows = messages.select("topic", "value", "headers")
    balanced(rows, "topic").write.partitionBy("topic").mode(mode).parquet(path)


def write_kafka(messages: DataFrame, servers: str) -> None:
    """Messages to a broker, without a key; needs the Kafka connector on the class path."""
    (
        messages.select("topic", F.col("value").cast("binary").alias("value"), "headers")
        .write.format("kafka").option("kafka.bootstrap.servers", servers).option("includeHeaders", "true").save()
    )


# The batch that holds documents appended without a batch id.
NO_BATCH = -1


def write_index(documents: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Documents as a table partitioned by batch and index.

    Without a ``batch_id`` they are appended. With one, the whole batch is replaced, whatever its
    indexes were: a batch replayed after midnight, or under new rules, leaves nothing behind.
    """
    rows = balanced(documents.select("index_name", "document"), "index_name")
    mode = "append" if batch_id is None else "overwrite"
    batch = NO_BATCH if batch_id is None else batch_id
    rows.write.partitionBy("index_name").mode(mode).option("partitionOverwriteMode", "static").parquet(f"{path}/batch_id={batch}")


def write_dead_letters(failed: DataFrame, path: str, batch_id: int) -> None:
    """Failed messages with what is needed to replay them; a replayed batch replaces itself."""
    rows = failed.select("topic", "error", "value", "headers")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/batch_id={batch_id}")


def write_archive(lines: DataFrame, path: str, compression: str = "gzip", mode: str = "append") -> None:
    """Newline-delimited text per topic. ``zstd`` is not a text codec here: it goes to Parquet."""
    rows = balanced(lines.select("topic", F.col("line").alias("value")), "topic").write.partitionBy("topic").mode(mode).option("partitionOverwriteMode", "static")
    if compression == "zstd":
        rows.option("compression", "zstd").parquet(path)
    elif compression in TEXT_CODECS:
        rows.option("compression", compression or "none").text(path)
    else:
        raise ValueError(f"compressor {compression!r} is not supported")
