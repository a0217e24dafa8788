"""Token-id files: Parquet with one row per document, laid out for selective reads.

A file row holds ``key``, ``part``, ``local_start``, ``n_tokens`` and ``ids`` (a list). Rows ascend by
key over the files and inside them. Ids are dictionary encoded (a page of ids costs bits, not four
bytes each) while the numbers beside them use delta encoding; row groups are kept small and the writer
adds page indexes, so a key range or the numbers alone are read without touching other ids. A file
knows its starts relative to its part; ``part_starts`` sums the parts, so nothing is rewritten and no
task sees more than its part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm.text import whole
from logloom.llm.tokenizing import SpacedEncoder, per_worker, read_tokenizer
from logloom.session import stored

#: Fixed value: the id that ends a document in the written stream.
END_ID = 2
#: Leading characters of a text that order the rows of one key before its hash does.
ORDER_CHARS = 64


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, head and hash of the text, n_tokens and packed ids of every text with ``end_id`` behind it, where the text is read.

    Packed ids are little-endian numbers of two bytes if the vocabulary allows it, else of four.
    """
    from tokenizers import Tokenizer

    source = read_tokenizer(docs.sparkSession, tokenizer_path)
    width = 2 if max(end_id, Tokenizer.from_str(source.value).get_vocab_size()) < 1 << 16 else 4

    def run(batches):
        encoder = per_worker(SpacedEncoder, source.value)
        tail = np.asarray([end_id], dtype=f"<u{width}").tobytes()
        for batch in batches:
            ids = [np.frombuffer(encoder.encode(t), dtype="<u4").astype(f"<u{width}").tobytes() + tail for t in batch.column(1).to_pylist()]
            sizes = pa.array([len(i) // width for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), sizes, pa.array(ids, pa.binary())], ["k", "head", "hash", "n", "p"])

    t = whole(F.col(text))
    narrow = docs.select(F.col(key).alias("k"), t.alias("t"), t.substr(1, ORDER_CHARS).alias("head"), F.xxhash64(t).alias("hash"))
    kind = narrow.schema["k"].dataType.simpleString()
    return narrow.mapInArrow(run, f"k {kind}, head string, hash bigint, n bigint, p binary")


def _laid_out(ordered: DataFrame, kind: str) -> DataFrame:
    """k, local_start, n_tokens, ids of rows in their order, partition by partition."""

    def run(batches):
        start = 0
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            starts = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            packed = batch.column(2).to_pylist()
            width = len(packed[0]) // int(sizes[0]) if packed else 4  # every text has an id at least
            ids = np.frombuffer(b"".join(packed), dtype=f"<u{width}").astype(np.int32)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["k", "s", "n", "i"])

    return ordered.select("k", "n", "p").mapInArrow(run, f"k {kind}, s bigint, n bigint, i array<int>")


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = END_ID,
    key: str = "doc_id",
    text: str = "text",
    row_group_bytes: int = 16 << 20,
    page_bytes: int = 256 << 10,
) -> None:
    """Write the files of ``docs`` in ascending key order.

    Texts are encoded once, where they are read; the packed ids, smaller than the texts, are stored and
    then move once. Null and empty texts hold the end id alone; null keys come first; rows that share a
    key follow each other, ordered by the head of the text and then its hash, and may fill several files,
    copies of one row included; an empty table writes no rows; other columns are not written.
    """
    packed = stored(encoded(docs, tokenizer_path, end_id, key, text).withColumn("row", F.monotonically_increasing_id()), "packed")
    order = ["k", "head", "hash", "row"]
    ordered = packed.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = _laid_out(ordered, packed.schema["k"].dataType.simpleString()).withColumn("part", F.spark_partition_id())
    writer = rows.select(F.col("k").alias(key), "part", F.col("s").alias("local_start"), F.col("n").alias("n_tokens"), F.col("i").alias("ids")).write
    for name, value in {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
        "parquet.dictionary.page.size": 1 << 20,
    }.items():
        writer = writer.option(name, str(value))
    writer.parquet(path)


def part_starts(files: DataFrame) -> DataFrame:
    """part, part_start: the ids in all parts before it. Reads only numbers, one row per part is left."""
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).cast("long").alias("part_start"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the ids of all documents before; select columns to read few."""
    files = spark.read.parquet(path)
    placed = files.join(F.broadcast(part_starts(files)), "part")  # one row per written part
    return placed.withColumn("start", F.col("part_start") + F.col("local_start")).drop("part", "part_start", "local_start")


def ids_crc32(ids: pa.ListArray) -> list[int]:
    """Unsigned crc32 of each list as little-endian unsigned 32-bit integers."""
    values = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
    offsets = ids.offsets.to_numpy()
    return [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def with_crc32(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and the ids_crc32 of column ``ids``."""

    def run(batches):
        for batch in batches:
            crc = pa.array(ids_crc32(batch.column("ids")), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), crc], [*columns, "ids_crc32"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.select(*columns, "ids").mapInArrow(run, f"{kinds}, ids_crc32 bigint")
