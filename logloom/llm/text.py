"""Words, text cleaning and task helpers that several operators share."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words after A-Z became a-z: everything in ASCII but digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def whole(text: Column) -> Column:
    """The text; null is the empty text."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """The lower-cased words of a text in order; null has none."""
    return F.array_remove(F.split(ascii_lower(whole(text)), SEPARATORS), "")


def keyed(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table per key value from batches that arrive sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key)
        start = 0
        ends = pa.compute.indices_nonzero(pa.compute.not_equal(keys.slice(1), keys.slice(0, max(len(keys) - 1, 0)))) if len(keys) > 1 else []
        if held and len(keys) and held[-1].column(key)[-1] != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for end in [int(e.as_py()) + 1 for e in ends]:
            yield pa.Table.from_batches([*held, batch.slice(start, end - start)])
            held, start = [], end
        if start < len(keys):
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
