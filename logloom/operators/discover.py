"""The shape of a column of JSON texts, found by one aggregation over all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.shapes import Shape, holds, leaves, like_json, merge, odd, parsed, read_shape, rewrite_shaped, type_of

#: Shapes that the driver reads, the most frequent ones, the length of one's description, and the leaves of the
#: merged type. They bound the driver's work and the plan; what they leave out takes the way of misfits.
MAX_SHAPES = 64
MAX_DESCRIPTION = 16384
MAX_LEAVES = 1000


def discover(rows: DataFrame, column: str) -> Shape:
    """The shape that holds the texts of ``column``, and how many it does not hold.

    All rows are described and counted by description, before and after one shuffle of descriptions; the
    driver sees at most ``MAX_SHAPES`` of them, of bounded length, whatever the input. The type is merged
    from these, the most frequent first. Texts of rarer, longer or irreconcilable shapes count as misfits,
    so they cost time but nothing is lost. Where descriptions do not prove that all texts fit, a second pass
    counts those that do not. Text that cannot be JSON is neither. Starts jobs when called.
    """
    text = F.col(column)
    described = F.schema_of_variant(F.try_variant_get(parsed(text), "$[0]", "variant"))
    plain = F.when(~odd(text) & (F.octet_length(described) <= MAX_DESCRIPTION), described)
    # the row of the roll-up that is not of one shape counts them all
    counted = rows.filter(like_json(text)).select(plain.alias("shape")).rollup("shape").agg(F.count("*").alias("n"), F.grouping_id().alias("total"))
    top = counted.filter("total = 1 OR shape IS NOT NULL").orderBy(F.desc("total"), F.desc("n"), "shape").limit(MAX_SHAPES + 1).collect()
    if not top:
        return Shape(type_of("null"))
    kinds = [(row.n, kind) for row in top[1:] if (kind := read_shape(row.shape)) is not None]
    kind = reduce(_wider, [kind for _, kind in kinds], merge(kinds[0][1], kinds[0][1])) if kinds else "null"
    held = sum(n for n, one in kinds if holds(kind, one))
    shape = Shape(type_of(kind))
    if held < top[0].n:  # a description may tell less than the text: a list of 1 and 2.5, for one
        unfit = like_json(text) & rewrite_shaped(text, shape, lambda path, value, dtype: None).isNull()
        shape = Shape(shape.dtype, rows.filter(unfit).count())
    return shape


def _wider(kind, other):
    merged = merge(kind, other)
    return merged if leaves(merged) <= MAX_LEAVES else kind
