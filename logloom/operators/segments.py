"""Archive flush segments: a buffer is flushed once it holds enough bytes, or when its time is up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.operators.chain import cell, chain
from logloom.operators.running import running_total
from logloom.session import stored

DEFAULT_MAX_BYTES = 52_428_800
DEFAULT_MAX_SECONDS = 3600
_SLICES = 720


def flush_segments(
    lines: DataFrame,
    *,
    topic: str = "topic",
    ts: str = "ts",
    seq: str = "seq",
    size: str = "bytes",
    max_bytes: int = DEFAULT_MAX_BYTES,
    max_seconds: int = DEFAULT_MAX_SECONDS,
) -> DataFrame:
    """Add ``flush_window`` and ``segment``, the number of the flush inside the window.

    A line joins the buffer while it holds fewer than ``max_bytes``, so the last one may
    overshoot; ``size`` excludes the newline and must be positive. ``max_bytes=0`` flushes on time
    only. The running byte count is added up over time slices and the flushes are links of a chain
    on the byte axis, so a topic that holds most of the data is worked on in parallel.
    """
    width = max_seconds * 1_000_000
    group = ["_topic", "_window"]
    timed = lines.withColumns({"_topic": F.col(topic), "_ts": F.unix_micros(F.col(ts)), "_seq": F.col(seq)})
    timed = timed.withColumn("_window", F.expr(f"_ts - pmod(_ts, {width}L)"))
    window = F.timestamp_micros("_window").alias("flush_window")
    if max_bytes <= 0:
        return timed.select(*lines.columns, window, F.lit(0).cast("long").alias("segment"))
    slice_ = F.expr(f"(_ts - _window) div {max(width // _SLICES, 1)}L")
    counted = running_total(timed, group, slice_, ["_ts", "_seq"], F.col(size).cast("long"), "_bytes")
    flushes = chain(counted, group, "_bytes", max_bytes, start=max_bytes, block_cells=16)
    return _assign(counted, flushes, max_bytes).select(*lines.columns, window, "segment")


def _assign(counted: DataFrame, flushes: DataFrame, max_bytes: int) -> DataFrame:
    """Find each line's segment by an equi-join on stretches of the byte axis.

    A segment reaches from the previous flush to its own. All its lines but the last end less
    than ``max_bytes`` after the previous flush, hence in that flush's stretch or the next one;
    the last line is the flush itself.
    """
    group = ["_topic", "_window"]
    ordered = W.partitionBy(*group).orderBy("anchor")
    closed = flushes.select(
        *group,
        F.col("anchor").alias("_until"),
        F.coalesce(F.lag("anchor").over(ordered), F.lit(0).cast("long")).alias("_from"),
        (F.row_number().over(ordered) - 1).cast("long").alias("segment"),
    )
    still_open = flushes.groupBy(*group).agg(
        F.max("anchor").alias("_from"), F.count("*").alias("segment")
    ).select(*group, F.lit(None).cast("long").alias("_until"), "_from", "segment")
    cells = "array_distinct(filter(array(_low, _low + 1, _high), c -> c IS NOT NULL))"
    spans = (
        closed.unionByName(still_open)
        .withColumn("_low", cell("_from", max_bytes))
        .withColumn("_high", cell("_until", max_bytes))
        .select(
            *[F.col(c).alias("_s" + c) for c in group], "_from", "_until", "segment", F.explode(F.expr(cells)).alias("_scell")
        )
    )
    inside = (
        F.col("_topic").eqNullSafe(F.col("_s_topic"))
        & F.col("_window").eqNullSafe(F.col("_s_window"))
        & (F.col("_cell") == F.col("_scell"))
        & (F.col("_bytes") > F.col("_from"))
        & (F.col("_until").isNull() | (F.col("_bytes") <= F.col("_until")))
    )
    # A window without any flush has no span: its lines stay in segment 0.
    return (
        counted.withColumn("_cell", cell("_bytes", max_bytes))
        .join(stored(spans, "flushes"), inside, "left")
        .withColumn("segment", F.coalesce("segment", F.lit(0).cast("long")))
    )
