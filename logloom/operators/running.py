"""Running totals that no single task has to compute alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def same_keys(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Null-safe equality on every column: a NULL key is a key like any other."""
    condition = F.lit(True)
    for column in columns:
        condition = condition & left[column].eqNullSafe(right[column])
    return condition


def totals_before(sums: DataFrame, group: list[str], slice_: str, amount: str) -> DataFrame:
    """Add ``_before``, the total of all earlier slices of the group. One row per slice: small."""
    earlier = W.partitionBy(*group).orderBy(slice_).rowsBetween(W.unboundedPreceding, -1)
    return sums.withColumn("_before", F.coalesce(F.sum(amount).over(earlier), F.lit(0)))


def running_total(
    df: DataFrame, group: list[str], slice_: Column, order: list[str], value: Column, name: str = "running"
) -> DataFrame:
    """Running total of ``value`` per group in the given order, as column ``name``.

    ``slice_`` must not decrease along the order. Sums per slice are combined before the shuffle
    and added up over the few slices; rows are then only ordered inside their slice, so a hot
    group is spread over its slices. Joining and ordering use the same hash partitioning.
    """
    sliced = df.withColumns({"_slice": slice_, "_value": value})
    sums = sliced.groupBy(*group, "_slice").agg(F.sum("_value").alias("_amount"))
    before = totals_before(sums, group, "_slice", "_amount").select(
        *[F.col(c).alias(f"_b_{c}") for c in [*group, "_slice"]], "_before"
    )
    match = F.lit(True)
    for column in [*group, "_slice"]:
        match = match & F.col(column).eqNullSafe(F.col(f"_b_{column}"))
    inside = W.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        sliced.join(before, match)
        .withColumn(name, F.col("_before") + F.sum("_value").over(inside))
        .drop(*[f"_b_{c}" for c in [*group, "_slice"]], "_before", "_slice", "_value")
    )
