"""Envelope operators: message format, decoding, batches of records sharing a context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.operators.documents import once
from logloom.schema import COLLECTION, COLLECTION_FORMAT, CONTEXT, FORMAT_HEADER, ITEM, PARSE_ERROR

_VALUE = T.StructType(
    [
        T.StructField("context", CONTEXT),
        T.StructField("timestamp", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("items", COLLECTION["items"].dataType),
        T.StructField("_unreadable", T.StringType()),
    ]
)


def is_collection(headers: Column) -> Column:
    """The first ``message_format`` header decides; without one a message is a single record."""
    formats = F.filter(headers, lambda h: h.getField("key") == FORMAT_HEADER)
    value = F.try_element_at(formats, F.lit(1)).getField("value").cast("string")
    return F.coalesce(value == COLLECTION_FORMAT, F.lit(False))


def decode(messages: DataFrame, value: str = "value", headers: str = "headers") -> DataFrame:
    """Turn message values into ``context``, ``items`` and ``error``; a single record is one item.

    One JSON parse per message serves both formats. A value that cannot be read keeps its row
    with ``error`` set, for ``dead_letter``; so does a collection that has no ``items`` at all.
    """
    parsed = F.from_json(F.col(value), _VALUE, {"columnNameOfCorruptRecord": "_unreadable"})
    collection = is_collection(F.col(headers))
    read = F.col("_v").isNotNull() & F.col("_v._unreadable").isNull() & (~collection | F.col("_v.items").isNotNull())
    single = F.array(F.struct("_v.timestamp", "_v.content"))
    return (
        once(messages, _v=parsed)
        .withColumns(
            {
                "error": F.when(~read, F.lit(PARSE_ERROR)),
                "context": F.when(read, F.col("_v.context")),
                "items": F.when(read, F.when(collection, F.col("_v.items")).otherwise(single)),
            }
        )
        .drop("_v")
    )


def explode_batch(batches: DataFrame, keep_unreadable: bool = False) -> DataFrame:
    """One row per record; every record inherits the context of its batch.

    With ``keep_unreadable`` a message that could not be decoded stays as one row without a
    position, so that good and bad rows go through one plan.
    """
    others = [c for c in batches.columns if c != "items"]
    explode = F.posexplode_outer if keep_unreadable else F.posexplode
    rows = batches.select(*others, explode("items").alias("position", "_item"))
    if keep_unreadable:
        rows = rows.filter("position IS NOT NULL OR error IS NOT NULL")
    return rows.select("*", "_item.timestamp", "_item.content").drop("_item")


def wrap_single(records: DataFrame) -> DataFrame:
    """Every record as a batch of one."""
    item = F.struct("timestamp", "content")
    return records.withColumn("items", F.array(item)).drop("timestamp", "content")


def collect_batch(
    records: DataFrame, batch: list[str], sequence: str, max_items: int | None = None
) -> DataFrame:
    """Group records into batches ordered by ``sequence``, the position inside the batch.

    A batch is one message, whatever its size. Only where ``max_items`` is given does a batch with
    more records become several messages of that many records, numbered by ``part`` from 0; each is
    then admitted on its own.
    """
    part = F.lit(0).cast("long")
    if max_items is not None:
        place = F.row_number().over(Window.partitionBy(*batch).orderBy(sequence)) - 1
        records = records.withColumn("_place", place)
        part = F.floor(F.col("_place") / max_items).cast("long")
    ordered = F.array_sort(
        F.collect_list(F.struct(F.col(sequence).alias("_seq"), F.struct("timestamp", "content").alias("_item")))
    )
    return (
        records.groupBy(*batch, part.alias("part"))
        .agg(ordered.alias("_items"))
        .withColumn("items", F.transform("_items", lambda i: i.getField("_item")))
        .drop("_items")
    )


def encode_single(records: DataFrame) -> DataFrame:
    """``value`` and ``headers`` of a message holding one record."""
    no_headers = F.array().cast("array<struct<key:string,value:binary>>")
    return records.withColumn(
        "value", F.to_json(F.struct("context", "timestamp", "content"))
    ).withColumn("headers", no_headers)


def encode_collection(batches: DataFrame) -> DataFrame:
    """``value`` and ``headers`` of a message holding a batch."""
    header = F.struct(
        F.lit(FORMAT_HEADER).alias("key"), F.lit(COLLECTION_FORMAT).cast("binary").alias("value")
    )
    return batches.withColumn("value", F.to_json(F.struct("context", "items"))).withColumn(
        "headers", F.array(header)
    )


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Good rows, and a dead-letter table with the rest: nothing vanishes."""
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull())
