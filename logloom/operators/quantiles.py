"""Quantiles of any number of rows per label: exact by bracketing and counting, or from stored sketches that merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.session import stored

#: Sub-ranges a bracket is counted in, and distinct values of one label and quantile that are ordered in one task.
BINS, ORDERED = 1024, 10_000
#: Size of a stored sketch: its rank error is below 1 % at this size.
SKETCH_K = 400


def sketches(df: DataFrame, value: str, *labels: str, every: str | None = None, ts: str = "ts", k: int = SKETCH_K, name: str = "sketch") -> DataFrame:
    """One mergeable quantile sketch per label (and window): a few KB however many rows it stands for.

    Store it, and roll hours up to days with ``merged_sketches`` without reading the rows again.
    """
    windows = [F.window(ts, every).getField("start").alias("window_start")] if every else []
    return df.groupBy(*labels, *windows).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias(name), F.count(value).alias("n"))


def merged_sketches(stored_sketches: DataFrame, *labels: str, every: str | None = None, k: int = SKETCH_K, name: str = "sketch") -> DataFrame:
    """Sketches of coarser labels or windows from finer ones."""
    windows = [F.window("window_start", every).getField("start").alias("window_start")] if every else []
    return stored_sketches.groupBy(*labels, *windows).agg(F.kll_merge_agg_double(name, F.lit(k)).alias(name), F.sum("n").alias("n"))


def sketched_quantiles(sketched: DataFrame, quantiles: tuple[float, ...], name: str = "sketch") -> DataFrame:
    """``p50``-style columns in place of the sketch; null for sketches without values."""
    made = {f"p{round(q * 100)}": F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(name, F.lit(q))) for q in quantiles}
    return sketched.withColumns(made).drop(name)


def exact_quantiles(
    df: DataFrame, value: str, labels: list[str], quantiles: tuple[float, ...], accuracy: int = 10_000
) -> DataFrame:
    """``labels``, ``n``, ``total`` and ``p50``-style columns: the value at rank ceil(q * n).

    A mergeable sketch first brackets each quantile between two values that are certainly below
    and above it. Counting the rows under the bracket and the distinct values inside it then gives the
    exact answer. A bracket with many distinct values is narrowed first, by counts of its sub-ranges, so
    no task ever orders more than a bounded number of them.
    """
    margin = 2.0 / accuracy
    count = len(quantiles)
    # A label that no row lacks lets the whole table be one group without a cross join.
    keys = {f"_l{k}": F.col(label) for k, label in enumerate(labels)} or {"_l0": F.when(F.col(value).isNotNull(), 0)}
    rows = df.filter(F.col(value).isNotNull()).select(
        *[c.alias(k) for k, c in keys.items()], F.col(value).alias("_v")
    )
    bounds = [min(max(q + side, 0.0), 1.0) for side in (-margin, margin) for q in quantiles]
    brackets = stored(
        rows.groupBy(*keys).agg(
            F.percentile_approx("_v", bounds, accuracy).alias("_b"), F.count("*").alias("n"), F.sum("_v").alias("total")
        ),
        "brackets",
    )
    placed = _merge(rows, brackets.select(*keys, "_b"), list(keys))
    below = placed.groupBy(*keys).agg(
        F.array(*[F.count_if(F.col("_v") < F.col("_b")[q]) for q in range(count)]).alias("_below")
    )
    inside = F.array(
        *[F.when((F.col("_v") >= F.col("_b")[q]) & (F.col("_v") <= F.col("_b")[count + q]), q) for q in range(count)]
    )
    near = (
        placed.select(*keys, "_v", F.explode(F.array_compact(inside)).alias("_q"))
        .groupBy(*keys, "_q", "_v")
        .agg(F.count("*").alias("_n"))
    )
    facts = _merge(brackets, below, list(keys))
    target = F.ceil(F.element_at(F.array(*[F.lit(q) for q in quantiles]), F.col("_q") + 1) * F.col("n"))
    wanted = (target - F.element_at("_below", F.col("_q") + 1)).cast("long").alias("_left")
    ranked = _merge(near, facts.select(*keys, "n", "_below"), list(keys)).select(*keys, "_q", "_v", "_n", wanted)
    narrow = _narrowed(stored(ranked, "near"), [*keys, "_q"])
    upto = W.partitionBy(*keys, "_q").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    found = (
        narrow.withColumn("_rank", F.sum("_n").over(upto))
        .filter(F.col("_rank") >= F.col("_left"))
        .groupBy(*keys)
        .agg(*[F.min(F.when(F.col("_q") == q, F.col("_v"))).alias(f"p{round(x * 100)}") for q, x in enumerate(quantiles)])
    )
    merged = _merge(facts.drop("_b", "_below"), found, list(keys))
    return merged.withColumnsRenamed(dict(zip(keys, labels))) if labels else merged.drop("_l0")


def _narrowed(near: DataFrame, keys: list[str]) -> DataFrame:
    """The values around rank ``_left`` of each key, with the rank counted from the first of them.

    Each round counts the rows of BINS sub-ranges and keeps the one that holds the rank; a round divides
    a range by BINS, so a handful settles any doubles.
    """
    while True:
        sizes = near.groupBy(*keys).agg(F.count("*").alias("_size"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        wide = stored(sizes.filter((F.col("_size") > ORDERED) & (F.col("_low") < F.col("_high"))), "wide")
        if wide.isEmpty():
            return near
        placed = _merge(near.withColumnRenamed("_left", "_rest"), sizes, keys)
        share = (F.col("_v").cast("double") - F.col("_low").cast("double")) / (F.col("_high").cast("double") - F.col("_low").cast("double"))
        bin_ = F.when((F.col("_size") > ORDERED) & (F.col("_low") < F.col("_high")), F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(0)
        binned = stored(placed.select(*keys, "_v", "_n", "_rest", F.coalesce(bin_, F.lit(0)).cast("int").alias("_bin")), "near")
        counts = binned.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_held"), F.first("_rest").alias("_wanted"))
        upto = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)  # at most BINS rows a key
        held = counts.withColumn("_upto", F.sum("_held").over(upto)).filter(F.col("_upto") >= F.col("_wanted"))
        # the first such range; what stands before it no longer counts
        first = held.groupBy(*keys).agg(F.min_by(F.struct("_bin", (F.col("_upto") - F.col("_held")).alias("_gone")), "_bin").alias("_first"))
        kept = _merge(binned, first, keys).filter(F.col("_bin") == F.col("_first._bin"))
        near = stored(kept.select(*keys, "_v", "_n", (F.col("_rest") - F.col("_first._gone")).cast("long").alias("_left")), "near")


def _merge(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys where NULL equals NULL; keeps the left keys."""
    renamed = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r{k}"))
    return left.join(renamed, same).drop(*[f"_r{k}" for k in keys])
