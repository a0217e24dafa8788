"""Session settings the operators rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin what changes results (UTC) and what keeps plans safe at scale (AQE, skew splitting)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # long texts: a batch for Python is small however many rows a partition has
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The one that ``spark.checkpoint.dir`` or ``setCheckpointDir`` names. Only where neither is set and
    everything runs in this one machine is it a folder in the warehouse; a cluster has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named and context._jsc.sc().getCheckpointDir().isDefined():
        named = context._jsc.sc().getCheckpointDir().get()
    if not named:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
    return named.rstrip("/")


def _run_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/logloom/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate or output tables, in the cluster's shared folder."""
    return f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results read from them are gone after that."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a side table and read it back.

    The lineage ends at a table that outlives executors, the work behind it runs once however
    often the table is used, and its size is known before the join that uses it is planned: Spark
    broadcasts it only within ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles
    both sides, splitting skewed keys. Without this a big side is shuffled before anyone knows
    how small the other one is.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, cores: int | None = None) -> DataFrame:
    """Round-robin a small scan over the cores before regex-heavy projections.

    A scan that already has at least one split per core (any large input) is returned
    as it is, so this never adds a shuffle to a big table.
    """
    wanted = cores or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
