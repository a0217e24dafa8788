"""Admission control: each request is admitted or refused whole, per key and time window.

Two policies share one interface:

* ``refill``  - a bucket holds quota * window tokens, a request takes its cost if that many are
  left, and a refused request takes nothing;
* ``counter`` - every request adds its cost, refused ones too, and is refused while the total
  exceeds quota * window.

A window either follows the clock (``tick``) or opens at the first request of its key after the
previous window ended (``first_hit``).

How this scales: decisions come from narrow sums per (key, window, time slice) that are combined
before the shuffle. Where a group stays within its quota nothing else happens. Only slices in which
the quota is crossed are ordered row by row. The greedy ``refill`` of unequal costs keeps, per
group and cost, the first rows that fit the quota on their own: tokens never grow inside a window,
so of each cost a prefix is admitted and everything beyond those rows is certainly refused. What
the fold sees is therefore bounded by the quota, not by the data. Decisions are written as a side
table, and only then joined to the full rows: groups within their quota have no entry in it, so it
is usually small enough for Spark to broadcast, and the rows themselves are never shuffled.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.operators.chain import cell, chain
from logloom.operators.running import totals_before
from logloom.schema import LIMIT_EXCEEDED
from logloom.session import stored

# Limiter names as configured -> (policy, anchor).
LIMITERS = {
    "LOCAL": ("refill", "tick"),
    "REDIS": ("counter", "first_hit"),
    "GUBERNATOR": ("refill", "first_hit"),
}
_SLICES = 64
_GROUP = ["_key", "_win"]


def limiter(name: str) -> dict[str, str]:
    """Options for ``admit`` from a limiter name, trimmed and in any case."""
    chosen = name.strip().upper()
    if chosen not in LIMITERS:
        raise ValueError(f"undefined rate limiter {name!r}, allowed: {', '.join(LIMITERS)}")
    policy, anchor = LIMITERS[chosen]
    return {"policy": policy, "anchor": anchor}


def admit(
    requests: DataFrame,
    *,
    key: str = "key",
    ts: str = "ts",
    seq: str = "seq",
    cost: str | None = None,
    max_tps: str | int = "max_tps",
    window_seconds: int = 10,
    policy: str = "refill",
    anchor: str = "tick",
) -> DataFrame:
    """Add ``window_start`` and ``admitted``. Requests are taken in order of (ts, seq).

    ``cost`` defaults to 1 per request; ``max_tps`` is a column or one number for all keys.
    Requests repeated with equal key, time, ``seq`` and cost all stay; each takes its cost and they share
    one verdict: admitted if every one of them fits. A request without a time, cost or quota is refused and
    leaves window, quota and tokens as they were: it opens no first-hit window and has none; it has the
    clock's window if it has a time.
    """
    if policy not in ("refill", "counter") or anchor not in ("tick", "first_hit"):
        raise ValueError(f"unknown policy {policy!r} or anchor {anchor!r}")
    fixed = isinstance(max_tps, int)
    quota = F.lit(max_tps) if fixed else F.col(max_tps)
    known = F.col(ts).isNotNull()
    for needed in ([] if cost is None else [cost]) + ([] if fixed else [max_tps]):
        known = known & F.col(needed).isNotNull()
    keyed = requests.withColumns(
        {
            "_known": known,
            "_key": F.col(key),
            "_ts": F.coalesce(F.unix_micros(F.col(ts)), F.lit(0).cast("long")),
            "_seq": F.col(seq),
            "_cost": F.lit(1).cast("long") if cost is None else F.coalesce(F.col(cost).cast("long"), F.lit(0).cast("long")),
            "_quota": F.coalesce(quota.cast("long") * window_seconds, F.lit(0).cast("long")),
        }
    )
    keyed = _tick_windows(keyed, window_seconds) if anchor == "tick" else _first_hit_windows(keyed, window_seconds)
    keyed = keyed.withColumn("_slice", F.expr(f"(_ts - _win) div {max(window_seconds * 1_000_000 // _SLICES, 1)}L"))
    if policy == "counter" or (cost is None and fixed):
        decided = _by_running_total(keyed, steady=fixed)
    else:
        decided = _by_refill(keyed, steady=fixed, carry=anchor == "tick")
    columns = [c for c in decided.columns if not c.startswith("_") or c in requests.columns]
    return decided.withColumns(
        {"window_start": F.when(F.col(ts).isNotNull(), F.timestamp_micros("_win")), "admitted": F.col("admitted") & F.col("_known")}
    ).select(*[c for c in columns if c != "admitted"], "window_start", "admitted")


def split_rejected(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Admitted rows, and refused rows with a ``reject_reason``."""
    rejected = decided.filter(~F.coalesce("admitted", F.lit(False))).withColumn("reject_reason", F.lit(LIMIT_EXCEEDED))
    return decided.filter("admitted").drop("admitted"), rejected.drop("admitted")


def _tick_windows(keyed: DataFrame, window_seconds: int) -> DataFrame:
    width = window_seconds * 1_000_000
    return keyed.withColumn("_win", F.expr(f"_ts - pmod(_ts, {width}L)"))


def _first_hit_windows(keyed: DataFrame, window_seconds: int) -> DataFrame:
    """Windows that open at a key's first hit; expiry has a resolution of one millisecond.

    The chain of openings is walked over distinct (key, millisecond) pairs. Openings are at least
    one window apart, so a row's opening lies in its own or the previous window-wide cell, which
    turns the as-of lookup into an equi-join on (key, cell).
    """
    width = window_seconds * 1000
    hits = keyed.withColumn("_ms", F.expr("(_ts - pmod(_ts, 1000L)) div 1000L"))
    opened = (
        stored(chain(hits.filter("_known"), ["_key"], "_ms", width), "windows")
        .withColumn("_cell", cell("anchor", width))
        .select(F.col("_key").alias("_wkey"), "anchor", F.explode(F.expr("array(_cell, _cell + 1)")).alias("_wcell"))
    )
    here = (
        F.col("_known")
        & F.col("_key").eqNullSafe(F.col("_wkey"))
        & (F.col("_cell") == F.col("_wcell"))
        & (F.col("_ms") >= F.col("anchor"))
        & (F.col("_ms") < F.col("anchor") + width)
    )
    return (
        hits.withColumn("_cell", cell("_ms", width))
        .join(opened, here, "left")
        .withColumn("_win", F.col("anchor") * 1000)
        .drop("_ms", "_cell", "_wkey", "_wcell", "anchor")
    )


def _on(left_columns: list[str], prefix: str) -> Column:
    condition = F.lit(True)
    for column in left_columns:
        condition = condition & F.col(column).eqNullSafe(F.col(prefix + column))
    return condition


def _prefixed(df: DataFrame, prefix: str, columns: list[str], *others: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in columns], *others)


def _shared(verdicts: DataFrame, verdict: str) -> DataFrame:
    """One verdict per place, so that the join back multiplies no repeated row."""
    return verdicts.groupBy(*[c for c in verdicts.columns if c != verdict]).agg(F.bool_and(verdict).alias(verdict))


def _by_running_total(keyed: DataFrame, steady: bool) -> DataFrame:
    """Admit while the running total, this request included, stays within the quota.

    Slices wholly within or beyond the quota are settled by their sums. In the slices between, one
    place (ts, seq) divides admitted from refused rows; only where a quota moves inside such a
    slice do the two mix, and those rows get a verdict each.
    """
    at = [*_GROUP, "_slice"]
    narrow = keyed.filter("_known").select(*at, "_cost", "_quota", "_ts", "_seq")
    sums = narrow.groupBy(*at).agg(
        F.sum("_cost").alias("_amount"), F.min("_quota").alias("_low"), F.max("_quota").alias("_high")
    )
    before = totals_before(sums, _GROUP, "_slice", "_amount")
    contested = stored(before.filter("_before + _amount > _low").select(*at, "_before", "_high"), "contested")
    inside = W.partitionBy(*at).orderBy("_ts", "_seq", "_cost").rowsBetween(W.unboundedPreceding, 0)
    crossing = _prefixed(contested.filter("_before <= _high"), "_c", at, "_before")
    verdicts = narrow.join(crossing, _on(at, "_c")).withColumn(
        "_fits", F.col("_before") + F.sum("_cost").over(inside) <= F.col("_quota")
    )
    place = F.struct("_ts", "_seq")
    cuts = verdicts.groupBy(*at).agg(
        F.min(F.when(~F.col("_fits"), place)).alias("_cut"), F.max(F.when(F.col("_fits"), place)).alias("_last")
    )
    slices = stored(
        contested.select(*[F.col(c).alias("_s" + c) for c in at], (F.col("_before") > F.col("_high")).alias("_over"))
        .join(cuts, _on(at, "_s"), "left")
        .select(*["_s" + c for c in at], "_over", "_cut", (F.col("_last") > F.col("_cut")).alias("_mixed")),
        "slices",
    )
    decided = keyed.join(slices, _on(at, "_s"), "left").withColumn(
        "admitted",
        F.when(F.col("_over").isNull(), True)
        .when(F.col("_over"), False)
        .otherwise(F.col("_cut").isNull() | (place < F.col("_cut"))),
    )
    mixed = slices.filter("_mixed").select(*["_s" + c for c in at])
    if steady or mixed.isEmpty():
        return decided
    row = [*_GROUP, "_ts", "_seq", "_cost"]
    exact = _prefixed(verdicts.join(mixed, _on(at, "_s"), "left_semi"), "_r", row, "_fits")
    return decided.join(stored(_shared(exact, "_fits"), "verdicts"), _on(row, "_r"), "left").withColumn(
        "admitted", F.coalesce("_fits", "admitted")
    )


def _by_refill(keyed: DataFrame, steady: bool, carry: bool) -> DataFrame:
    """Greedy bucket: admit whatever still fits.

    ``steady`` promises one quota for all rows. Otherwise groups are steady when neither they nor
    the window before them (whose last quota filled the bucket, if ``carry``) saw a change; groups
    with a change are replayed request by request.
    """
    narrow = keyed.filter("_known").select(*_GROUP, "_slice", "_cost", "_quota", "_ts", "_seq")
    groups = narrow.groupBy(*_GROUP).agg(
        F.sum("_cost").alias("_total"), F.min("_quota").alias("_low"), F.max("_quota").alias("_high")
    )
    if steady:
        groups = groups.withColumns({"_tokens": F.col("_high"), "_moving": F.lit(False), "_filled": F.lit(None).cast("long")})
    else:
        previous = W.partitionBy("_key").orderBy("_win")
        filled = F.when(F.lag("_low").over(previous) == F.lag("_high").over(previous), F.lag("_high").over(previous))
        unknown = F.lag("_low").over(previous) != F.lag("_high").over(previous)
        if not carry:
            filled, unknown = F.lit(None).cast("long"), F.lit(False)
        groups = groups.withColumn("_filled", filled).withColumns(
            {
                "_tokens": F.greatest("_high", "_filled"),
                "_moving": (F.col("_low") != F.col("_high")) | F.coalesce(unknown, F.lit(False)),
            }
        )
    exceptional = stored(groups.filter("_moving OR _total > _tokens"), "groups")
    contested, moving = exceptional.filter("NOT _moving"), exceptional.filter("_moving")
    limits = stored(_limits(narrow, contested), "limits")
    decided = keyed.join(limits, _on(_GROUP, "_l"), "left").withColumn(
        "admitted",
        (F.col("_cost") == 0)
        | F.col("_ltokens").isNull()
        | (
            (F.col("_cost") <= F.col("_ltokens"))
            & F.coalesce(
                F.struct("_ts", "_seq") < F.try_element_at("_lfirst", F.col("_cost")), F.lit(True)
            )
        ),
    )
    if steady or moving.isEmpty():
        return decided
    replayed = stored(_shared(_replay(narrow, moving, carry), "_radmitted"), "replayed")
    row = [*_GROUP, "_ts", "_seq", "_cost"]
    return decided.join(replayed, _on(row, "_r"), "left").withColumn(
        "admitted", F.coalesce("_radmitted", "admitted")
    )


def _limits(narrow: DataFrame, contested: DataFrame) -> DataFrame:
    """Per contested group its tokens and, by cost, the first (ts, seq) that is refused."""
    same_cost = [*_GROUP, "_cost"]
    rows = narrow.filter("_cost > 0").join(_prefixed(contested, "_g", _GROUP, "_tokens"), _on(_GROUP, "_g"))
    rows = rows.filter("_cost <= _tokens")
    sums = rows.groupBy(*same_cost, "_slice").agg(F.sum("_cost").alias("_amount"), F.first("_tokens").alias("_tokens"))
    fitting = _prefixed(
        totals_before(sums, same_cost, "_slice", "_amount").filter("_before <= _tokens"),
        "_f", [*same_cost, "_slice"], "_before",
    )
    earlier = W.partitionBy(*same_cost, "_slice").orderBy("_ts", "_seq").rowsBetween(W.unboundedPreceding, -1)
    candidates = (
        rows.join(fitting, _on([*same_cost, "_slice"], "_f"))
        .withColumn("_own", F.col("_before") + F.coalesce(F.sum("_cost").over(earlier), F.lit(0)))
        .filter("_own <= _tokens")
        .groupBy(*_GROUP)
        .agg(
            F.array_sort(F.collect_list(F.struct("_ts", "_seq", "_cost"))).alias("_rows"),
            F.first("_tokens").alias("_tokens"),
        )
    )
    refused = candidates.schema["_rows"].dataType

    def take(state: Column, request: Column) -> Column:
        left, first = state.getField("left"), state.getField("first")
        spent = left - request.getField("_cost")
        known = F.exists(first, lambda f: f.getField("_cost") == request.getField("_cost"))
        return F.struct(
            F.when(spent >= 0, spent).otherwise(left).alias("left"),
            F.when((spent >= 0) | known, first).otherwise(F.array_append(first, request)).alias("first"),
        )

    start = F.struct(F.col("_tokens").alias("left"), F.array().cast(refused).alias("first"))
    folded = F.aggregate("_rows", start, take, lambda state: state.getField("first"))
    by_cost = F.map_from_entries(
        F.transform(folded, lambda f: F.struct(f.getField("_cost"), F.struct(f.getField("_ts"), f.getField("_seq"))))
    )
    firsts = candidates.select(*[F.col(c).alias("_f" + c) for c in _GROUP], by_cost.alias("_lfirst"))
    every = contested.select(*_GROUP, F.col("_tokens").alias("_ltokens")).join(firsts, _on(_GROUP, "_f"), "left")
    return _prefixed(every, "_l", _GROUP, "_ltokens", "_lfirst")


def _replay(narrow: DataFrame, moving: DataFrame, carry: bool) -> DataFrame:
    """Request-by-request replay of the windows in which a key's quota changes.

    A raised quota adds the difference at once, a lowered one counts from the next refill. Windows
    depend on each other only through the last quota before them, which is looked up first, so the
    windows of one key run in parallel. The rows of a window stream through in order with constant
    state; nothing is collected.
    """
    rows = narrow.join(_prefixed(moving, "_m", _GROUP, "_filled"), _on(_GROUP, "_m")).drop("_m_key", "_m_win")
    last = rows.groupBy(*_GROUP).agg(
        F.max_by("_quota", F.struct("_ts", "_seq")).alias("_last"), F.first("_filled").alias("_known")
    )
    if carry:
        # Without a known fill the window before this one moved too, or there is none.
        before = F.lag("_last").over(W.partitionBy("_key").orderBy("_win"))
        fills = last.withColumn("_fill", F.coalesce("_known", before))
    else:
        fills = last.withColumn("_fill", F.lit(None).cast("long"))
    ordered = (
        rows.join(stored(_prefixed(fills, "_p", _GROUP, "_fill"), "fills"), _on(_GROUP, "_p"))
        .select(*_GROUP, "_ts", "_seq", "_cost", "_quota", "_fill")
        .repartition(*_GROUP)
        .sortWithinPartitions(*_GROUP, "_ts", "_seq", "_cost")
    )
    out = T.StructType(
        [T.StructField("_r" + f.name, f.dataType) for f in ordered.schema.fields if f.name in (*_GROUP, "_ts", "_seq", "_cost")]
        + [T.StructField("_radmitted", T.BooleanType())]
    )

    def run(batches):
        group, quota, left = None, None, 0
        for batch in batches:
            admitted = []
            for key, win, cost, wanted, fill in zip(
                batch["_key"], batch["_win"], batch["_cost"], batch["_quota"], batch["_fill"], strict=True
            ):
                if (key, win) != group:
                    quota = wanted if pd.isna(fill) else int(fill)
                    group, left = (key, win), quota
                if wanted > quota:
                    left += wanted - quota
                quota = wanted
                admitted.append(cost <= left)
                if cost <= left:
                    left -= cost
            frame = batch[["_key", "_win", "_ts", "_seq", "_cost"]].add_prefix("_r")
            frame["_radmitted"] = admitted
            yield frame

    return ordered.mapInPandas(run, out)
