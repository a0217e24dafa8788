"""Many small objects in a folder that driver and executors share, written and read by the tasks themselves.

An object is a folder ``topic=../object=..`` with one text file, as Spark's writer with ``partitionBy`` lays it out and
as its reader reads it. Without native libraries Hadoop's local file system starts a process for each file that it
makes, and a reader lists all of them on the driver; for objects of a few lines that is most of the work. Other file
systems than ``file`` have neither cost and are left to Spark's writer and reader.
"""

from __future__ import annotations

import gzip
import io
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODECS = {"": "", "gzip": ".gz"}
LISTED = "_objects"  # names of the objects written, beside them; the folder is complete once the listing is
_LINES = 4096
_ESCAPED = re.compile(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]")


def shared_folder(spark: SparkSession, path: str) -> str | None:
    """The folder that ``path`` names if it is one of the ``file`` system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _name(topic: str | None, object_: str | None) -> str:
    """The folder of an object, as Spark writes values in a path."""
    values = (_ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", v) if v else "__HIVE_DEFAULT_PARTITION__" for v in (topic, object_))
    return "topic={}/object={}".format(*values)


def write_objects(ordered: DataFrame, folder: str, listing: str, compression: str) -> None:
    """Write ``topic, object, value`` below ``folder``; lines of an object are behind each other in one partition.

    A task has one object open. A file appears under its name when it is whole, and a task that runs again replaces
    its files.
    """
    suffix = CODECS[compression]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, key, at, out, part = TaskContext.get().partitionId(), 0, None, "", None, ""

        def close() -> None:
            out.close()
            os.replace(part, f"{at}/part-{task:05d}-{number:06d}.txt{suffix}")

        for batch in batches:
            names = []
            for topic, object_, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (topic, object_) != key or not out:
                    if out:
                        close()
                    number, key, names = number + 1, (topic, object_), [*names, _name(topic, object_)]
                    at = f"{folder}/{names[-1]}"
                    os.makedirs(at, exist_ok=True)
                    part = f"{at}/.{uuid.uuid4().hex}"
                    out = gzip.open(part, "wb", compresslevel=6) if suffix else open(part, "wb")
                out.write(value + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["value"])
        if out:
            close()

    rows = ordered.select("topic", "object", F.col("value").cast("binary").alias("value"))
    rows.mapInArrow(run, "value string").write.mode("overwrite").option("partitionOverwriteMode", "static").text(listing)


def read_objects(named: DataFrame, folder: str) -> DataFrame:
    """``topic, object, value, batch_id`` of the objects that ``batch_id, topic, object`` name, each read by the task that has its name."""
    schema = "topic string, object string, value binary, batch_id bigint"

    def lines(name: str) -> Iterator[bytes]:
        if not os.path.isdir(f"{folder}/{name}"):
            return
        for file in sorted(os.listdir(f"{folder}/{name}")):
            if file[0] not in "._":
                opened = gzip.open if file.endswith(".gz") else open
                with io.TextIOWrapper(opened(f"{folder}/{name}/{file}", "rb"), encoding="latin-1") as text:  # bytes, cut at \n, \r\n and \r
                    yield from (line.removesuffix("\n").encode("latin-1") for line in text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.string(), pa.string(), pa.binary(), pa.int64()), strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["topic", "object", "value", "batch_id"])

        for rows in batches:
            for batch_id, topic, object_ in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                for line in lines(f"batch_id={batch_id}/{_name(topic, object_)}"):
                    held.append((topic, object_, line, batch_id))
                    if len(held) >= _LINES:
                        yield batch()
                        held = []
        if held:
            yield batch()

    whole = named.select("batch_id", "topic", "object").dropna().distinct()
    spread = whole.repartition(4 * named.sparkSession.sparkContext.defaultParallelism)  # names are small, what they name is not
    return spread.mapInArrow(run, schema).withColumn("value", F.col("value").cast("string"))
