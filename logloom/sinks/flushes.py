"""Archives written flush by flush, with a manifest that readers trust.

A flush is what a buffer held when it was full or its time was up (``operators.segments``). Each flush is one
object, a folder named as ``archive_path`` names it, written by one task; a topic that holds most of the data
has many flushes and so many tasks. The manifest gets its rows after the objects of a batch are complete:
objects of a run that failed are not in it, and a batch that runs again replaces objects and rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.document import archive_path
from logloom.operators.segments import DEFAULT_MAX_BYTES, DEFAULT_MAX_SECONDS, flush_segments
from logloom.session import stored
from logloom.sinks import objects
from logloom.sinks.tables import NO_BATCH, TEXT_CODECS

SUCCESS, FAILURE = "success", "failure"
MANIFEST = (
    "batch_id bigint, topic string, flush_window timestamp, segment bigint, object string, first_ts timestamp, last_ts timestamp, "
    "lines bigint, bytes bigint, outcome string, error string"
)
_COLUMNS = [c.split()[0] for c in MANIFEST.split(", ")]


def planned_flushes(segmented: DataFrame, max_seconds: int, compression: str) -> DataFrame:
    """One row per flush: what it holds and its ``object`` name below the archive's path.

    A full buffer is flushed at its last line, a last one of its window when the window ends. Flushes of a
    topic within one second are told apart by a number.
    """
    flushes = segmented.groupBy("topic", "flush_window", "segment").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("lines"), F.sum("bytes").alias("bytes")
    )
    last = F.col("segment") == F.max("segment").over(W.partitionBy("topic", "flush_window"))
    ends = F.timestamp_micros(F.unix_micros("flush_window") + F.lit(max_seconds * 1_000_000))
    timed = flushes.withColumn("_at", F.when(last, ends).otherwise(F.col("last_ts")))
    second = W.partitionBy("topic", F.date_trunc("second", "_at")).orderBy("flush_window", "segment")
    number = F.row_number().over(second) - 1
    name = archive_path("", F.col("topic"), F.col("_at"), compression if compression in ("", "gzip", "zstd") else "")
    return timed.withColumn("object", F.concat(F.element_at(F.split(name, "/"), -1), F.when(number > 0, F.concat(F.lit("."), number.cast("string"))).otherwise(""))).drop("_at")


def write_flushes(
    lines: DataFrame,
    path: str,
    batch_id: int = NO_BATCH,
    *,
    ts: str = "ts",
    seq: str = "seq",
    line: str = "line",
    compression: str = "gzip",
    max_bytes: int = DEFAULT_MAX_BYTES,
    max_seconds: int = DEFAULT_MAX_SECONDS,
    on_flush=None,
) -> DataFrame:
    """Write lines (``topic``, time, number, text) as one object per flush, then the manifest; returns its rows.

    Lines of an object are in order of (ts, seq). ``on_flush(manifest rows)`` is called when all is written. A
    failed write leaves rows with outcome ``failure`` beside the manifest and raises. Null lines are left
    out, null times belong to the flushes of the year 1970, an empty batch writes an empty manifest part.
    """
    if compression not in (*TEXT_CODECS, "zstd"):
        raise ValueError(f"compressor {compression!r} is not supported")
    spark = lines.sparkSession
    at = F.coalesce(F.col(ts), F.timestamp_micros(F.lit(0)))
    rows = lines.filter(F.col(line).isNotNull()).select("topic", at.alias("ts"), F.col(seq).alias("seq"), F.col(line).alias("line"))
    # an empty line still takes its place in the order of bytes
    sized = rows.withColumn("bytes", F.greatest(F.octet_length("line"), F.lit(1)))
    segmented = stored(flush_segments(sized, max_bytes=max_bytes, max_seconds=max_seconds), "segmented")
    exact = segmented.withColumn("bytes", F.octet_length("line"))
    plan = stored(planned_flushes(exact, max_seconds, compression), "flushes")
    target = f"{path.rstrip('/')}/batch_id={batch_id}"
    key = [segmented["topic"].eqNullSafe(plan["topic"]), segmented["flush_window"] == plan["flush_window"], segmented["segment"] == plan["segment"]]
    named = segmented.join(plan.select("topic", "flush_window", "segment", "object"), key).select(segmented["topic"], "object", "ts", "seq", F.col("line").alias("value"))
    ordered = named.repartition("topic", "object").sortWithinPartitions("topic", "object", "ts", "seq").select("topic", "object", "value")
    folder = objects.shared_folder(spark, target) if compression in objects.CODECS else None
    manifest = plan.withColumn("batch_id", F.lit(batch_id).cast("long"))
    failed = f"{_manifest(path)}-failures/batch_id={batch_id}"
    _delete(spark, f"{_manifest(path)}/batch_id={batch_id}")  # until all is written nothing vouches for the batch
    try:
        writer = ordered.write.partitionBy("topic", "object").mode("overwrite").option("partitionOverwriteMode", "static")
        if folder:
            _delete(spark, target)
            objects.write_objects(ordered, folder, f"{target}/{objects.LISTED}", compression)
        elif compression == "zstd":
            writer.option("compression", "zstd").parquet(target)
        else:
            writer.option("compression", compression or "none").text(target)
    except Exception as error:  # noqa: BLE001 - noted, then raised again
        noted = manifest.withColumns({"outcome": F.lit(FAILURE), "error": F.lit(str(error)[:500])})
        noted.select(*[F.col(c) for c in _COLUMNS if c != "batch_id"]).write.mode("append").parquet(failed)
        raise
    done = manifest.withColumns({"outcome": F.lit(SUCCESS), "error": F.lit(None).cast("string")})
    done.select(*[F.col(c) for c in _COLUMNS if c != "batch_id"]).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{_manifest(path)}/batch_id={batch_id}")
    written = read_manifest(spark, path).filter(F.col("batch_id") == batch_id)
    if on_flush is not None:
        on_flush(written)
    return written


def _manifest(path: str) -> str:
    return f"{path.rstrip('/')}/_manifest"


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _named(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the files and folders that a pattern fits."""
    files, target = _at(spark, pattern)
    return [found.getPath().getName() for found in files.globStatus(target) or []]


def _delete(spark: SparkSession, path: str) -> None:
    files, target = _at(spark, path)
    files.delete(target, True)


def _listed(spark: SparkSession, path: str) -> bool:
    """Whether tasks wrote the objects of every batch in the manifest."""
    return all(_named(spark, f"{path.rstrip('/')}/{batch}/{objects.LISTED}/_SUCCESS") for batch in _named(spark, f"{_manifest(path)}/batch_id=*"))


def read_manifest(spark: SparkSession, path: str, failures: bool = False) -> DataFrame:
    """The manifest's rows; with ``failures`` also those of writes that failed. Folders with a leading underscore are no archive."""
    parts = [p for p in (_manifest(path), f"{_manifest(path)}-failures")[: 1 + failures] if _named(spark, f"{p}/batch_id=*")]
    found = spark.createDataFrame([], MANIFEST)
    for part in parts:
        found = found.unionByName(spark.read.schema(MANIFEST).option("basePath", part).parquet(f"{part}/batch_id=*"))
    return found


def read_archive(spark: SparkSession, path: str, compression: str = "gzip") -> DataFrame:
    """topic, object, value, batch_id of the lines that the manifest vouches for; other objects are not read as results."""
    named = read_manifest(spark, path).filter(F.col("outcome") == SUCCESS).select("batch_id", "topic", "object")
    folder = objects.shared_folder(spark, path) if compression in objects.CODECS else None
    if folder and _listed(spark, path):
        return objects.read_objects(named, folder)
    schema = "value string, batch_id bigint, topic string, object string"
    reader = spark.read.schema(schema).option("basePath", path)
    files = f"{path.rstrip('/')}/batch_id=*"
    lines = reader.parquet(files) if compression == "zstd" else reader.format("text").load(files)
    return lines.join(named, ["batch_id", "topic", "object"], "left_semi").select("topic", "object", "value", "batch_id")


def uploads(manifest: DataFrame, *labels: str) -> DataFrame:
    """Flushes, lines and uncompressed bytes per label and outcome."""
    return manifest.groupBy(*labels, "outcome").agg(F.count("*").alias("uploads"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))
