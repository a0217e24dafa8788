"""The registry of known topics: an insert-only table in which each topic stands once, whatever is replayed.

A batch adds the topics that no earlier batch has, in a folder of its number. It looks at earlier numbers
only, so a batch that runs again finds the same topics new and replaces what it had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.operators.topics import topic_events

REGISTRY = "topic string, partitions int, replication int, batch_id bigint"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Known topics with their options and the batch that created them; none where nothing is written yet."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], REGISTRY)
    return spark.read.schema(REGISTRY).parquet(path)


def register_topics(logs: DataFrame, path: str, batch_id: int, order: list[str], ignore_options: bool = False, announce=None) -> DataFrame:
    """Add the unseen topics of ``logs`` with the options of their first record; returns the rows added.

    ``announce(rows)`` is called once they are written, again if the batch is replayed: those who listen see a
    creation at least once, the table has it exactly once.
    """
    spark = logs.sparkSession
    known = read_registry(spark, path).filter(F.col("batch_id") < batch_id)
    target = f"{path.rstrip('/')}/batch_id={batch_id}"
    unseen = topic_events(logs, known, order, ignore_options).select("topic", F.col("partitions").cast("int"), F.col("replication").cast("int"))
    unseen.repartition(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(target)  # small rows, one a topic; what finds them stays spread
    added = read_registry(spark, path).filter(F.col("batch_id") == batch_id)
    if announce is not None:
        announce(added)
    return added


def registry_stream(
    logs: DataFrame, path: str, checkpoint: str, order: list[str], *, ignore_options: bool = False, announce=None, every: str | None = None
) -> StreamingQuery:
    """Each topic of a stream of logs into the registry, once over all restarts."""

    def store(batch: DataFrame, batch_id: int) -> None:
        register_topics(batch, path, batch_id, order, ignore_options, announce)

    writer = logs.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
