"""Admission against a plain simulation, with hot keys, equal timestamps and moving quotas."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logloom.operators.admit import admit, limiter, split_rejected

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "key string, ts timestamp, seq long, cost int, max_tps int"


def simulate(rows, window, policy, anchor):
    """The verdict of each request, taken one by one in order of (ts, seq)."""
    state, verdicts = {}, {}
    for key, ts, seq, cost, max_tps in sorted(rows, key=lambda r: (r[1], r[2])):
        now = int((ts - START).total_seconds() * 1_000_000 + 0.5)
        quota, width = max_tps * window, window * 1_000_000
        opened, held, used, last = state.get(key, (None, quota, 0, quota))
        if opened is None or now >= opened + width:
            fresh = opened is None or anchor == "first_hit"
            held, used = (quota if fresh else last), 0
            last = held
            opened = now - now % width if anchor == "tick" else now - now % 1000
        if policy == "counter":
            used += cost
            verdicts[seq] = used <= quota
        else:
            held += max(quota - last, 0)
            verdicts[seq] = used + cost <= held
            used += cost if verdicts[seq] else 0
        state[key] = (opened, held, used, quota)
    return verdicts


def requests(seed, count=3000, quota=lambda key, n: 2, spread_ms=60_000):
    """A third and more of all requests belong to one key, many share a timestamp."""
    source = random.Random(seed)
    rows = []
    for n in range(count):
        key = "hot" if source.random() < 0.5 else source.choice(["a", "b", "c", None])
        at = source.randrange(0, spread_ms, 7 if source.random() < 0.5 else 2000)
        rows.append((key, START + timedelta(milliseconds=at), n, source.choice([0, 1, 1, 2, 3, 7, 40]), quota(key, n)))
    return rows


def verdicts(spark, rows, **options):
    decided = admit(spark.createDataFrame(rows, SCHEMA), **options)
    return {row.seq: row.admitted for row in decided.collect()}


@pytest.mark.parametrize("anchor", ["tick", "first_hit"])
@pytest.mark.parametrize("policy", ["refill", "counter"])
@pytest.mark.parametrize(
    "quota",
    [lambda key, n: 20, lambda key, n: 50 if key == "hot" else 9, lambda key, n: 1 + n // 300 % 4 * 10],
    ids=["one", "per-key", "moving"],
)
def test_equals_simulation(spark, policy, anchor, quota):
    rows = requests(7, quota=quota)
    wanted = simulate(rows, 5, policy, anchor)
    assert verdicts(spark, rows, cost="cost", window_seconds=5, policy=policy, anchor=anchor) == wanted
    assert 0 < sum(wanted.values()) < len(rows)


def test_unit_cost_and_fixed_quota(spark):
    rows = [(k, t, s, 1, 3) for k, t, s, _, _ in requests(3)]
    wanted = simulate(rows, 5, "refill", "tick")
    assert verdicts(spark, rows, max_tps=3, window_seconds=5) == wanted
    assert verdicts(spark, rows, window_seconds=5) == wanted


def test_one_instant_holds_everything(spark):
    rows = [("hot", START, n, 1 + n % 3, 4) for n in range(2000)]
    wanted = simulate(rows, 5, "refill", "tick")
    assert verdicts(spark, rows, cost="cost", window_seconds=5) == wanted
    assert sum(wanted.values()) == 11  # 1+2+3 three times, then 1 and, after refusals, 1 again


def test_refill_admits_at_least_what_the_counter_admits_and_keeps_the_quota(spark):
    rows = requests(11, quota=lambda key, n: 8)
    refill = verdicts(spark, rows, cost="cost", window_seconds=5)
    counter = verdicts(spark, rows, cost="cost", window_seconds=5, policy="counter")
    assert all(refill[s] for s, ok in counter.items() if ok)
    spent = {}
    for key, ts, seq, cost, _ in rows:
        slot = (key, int((ts - START).total_seconds()) // 5)
        spent[slot] = spent.get(slot, 0) + cost * refill[seq]
    assert max(spent.values()) <= 40


def golden(spark, steps, **options):
    rows = [(key, START + timedelta(milliseconds=at), n, cost, tps) for n, (key, at, cost, tps) in enumerate(steps)]
    found = verdicts(spark, rows, cost="cost", window_seconds=1, **options)
    return [found[n] for n in range(len(steps))]


def test_golden_cases(spark):
    unit = [("k", n, 1, 5) for n in range(6)] + [("other", 6, 1, 5), ("k", 1000, 1, 5)]
    assert golden(spark, unit) == [True] * 5 + [False, True, True]
    assert golden(spark, [("k", 0, 6, 5), ("k", 1, 5, 5)]) == [False, True]
    assert golden(spark, [("new", 0, 1, 13)]) == [True]
    assert golden(spark, [("k", n, 1, 4) for n in range(4)] + [("k", 5, 1, 6)]) == [True] * 5
    assert golden(spark, [("k", 0, 2, 4), ("k", 1, 2, 6), ("k", 2, 1, 6)]) == [True] * 3
    assert golden(spark, [("k", 0, 6, 10), ("k", 1, 4, 5), ("k", 1000, 6, 5)]) == [True, True, False]
    assert golden(spark, [("k", n, 2, 6) for n in range(5)], policy="counter") == [True] * 3 + [False] * 2


@pytest.mark.parametrize("anchor", ["tick", "first_hit"])
@pytest.mark.parametrize("policy", ["refill", "counter"])
@pytest.mark.parametrize("quota", [lambda n: 3, lambda n: 1 + n // 30 % 4 * 2], ids=["steady", "moving"])
def test_repeated_requests_are_kept_and_share_a_verdict(spark, anchor, policy, quota):
    rows = [(k, t, s, c, quota(s)) for k, t, s, c, _ in requests(17, count=300)]
    rows += [r for r in rows if r[2] % 3 == 0] + [r for r in rows if r[2] % 6 == 0]
    decided = admit(spark.createDataFrame(rows, SCHEMA), cost="cost", window_seconds=5, policy=policy, anchor=anchor).collect()
    assert sorted(r.seq for r in decided) == sorted(r[2] for r in rows)
    assert len({(r.seq, r.admitted) for r in decided}) == 300


def test_limiter_names():
    assert limiter(" local ") == {"policy": "refill", "anchor": "tick"}
    assert limiter("Redis") == {"policy": "counter", "anchor": "first_hit"}
    assert limiter("gubernator") == {"policy": "refill", "anchor": "first_hit"}
    with pytest.raises(ValueError):
        limiter("memcached")


def test_refused_rows_keep_all_columns(spark):
    rows = requests(5, count=200)
    decided = admit(spark.createDataFrame(rows, SCHEMA), cost="cost", window_seconds=5)
    good, bad = split_rejected(decided)
    assert good.count() + bad.count() == 200
    assert set(bad.columns) == {"key", "ts", "seq", "cost", "max_tps", "window_start", "reject_reason"}


@pytest.mark.parametrize("anchor", ["tick", "first_hit"])
@pytest.mark.parametrize("policy", ["refill", "counter"])
def test_requests_without_time_or_cost_are_refused_and_kept(spark, anchor, policy):
    rows = [("k", n, None if n == 3 else f"2024-01-01 00:00:0{n}", None if n == 5 else 1) for n in range(8)]
    requests = spark.createDataFrame(rows, "key string, seq int, t string, cost int").withColumn("ts", F.col("t").cast("timestamp"))
    good, bad = split_rejected(admit(requests, cost="cost", max_tps=1, window_seconds=4, policy=policy, anchor=anchor))
    assert sorted([r.seq for r in good.collect()] + [r.seq for r in bad.collect()]) == list(range(8))
    assert {3, 5} <= {r.seq for r in bad.collect()}


def simulate_known(rows, window, policy, anchor):
    """As ``simulate``; requests without a time, cost or quota are refused and change nothing."""
    known = [r for r in rows if None not in (r[1], r[3], r[4])]
    return dict.fromkeys((r[2] for r in rows), False) | simulate(known, window, policy, anchor)


@pytest.mark.parametrize("anchor", ["tick", "first_hit"])
@pytest.mark.parametrize("policy", ["refill", "counter"])
@pytest.mark.parametrize("quota", [lambda key, n: 20, lambda key, n: 1 + n // 300 % 4 * 10], ids=["steady", "moving"])
def test_requests_with_nulls_leave_the_bucket_as_it_was(spark, anchor, policy, quota):
    rows = [
        (key, None if n % 11 == 3 else at, n, None if n % 7 == 2 else cost, None if n % 5 == 1 else tps)
        for n, (key, at, _, cost, tps) in enumerate(requests(23, quota=quota))
    ]
    wanted = simulate_known(rows, 5, policy, anchor)
    assert verdicts(spark, rows, cost="cost", window_seconds=5, policy=policy, anchor=anchor) == wanted
    assert 0 < sum(wanted.values()) < len(rows)


@pytest.mark.parametrize("anchor", ["tick", "first_hit"])
def test_a_null_quota_does_not_refill(spark, anchor):
    steps = [("k", n, 1, 10) for n in range(10)] + [("k", 20, 1, None)] + [("k", 30 + n, 1, 10) for n in range(10)]
    assert golden(spark, steps, anchor=anchor) == [True] * 10 + [False] * 11


def test_a_window_of_nulls_only_does_not_hide_the_last_quota(spark):
    steps = [("k", 0, 1, 10), ("k", 1500, 5, None), ("k", 2000, 8, 4), ("k", 2001, 8, 4)]
    assert golden(spark, steps) == [True, False, True, False]


def test_a_null_opens_no_first_hit_window(spark):
    steps = [("k", 0, None, 1), ("k", 900, 1, 1), ("k", 1100, 1, 1), ("k", 1950, 1, 1)]
    assert golden(spark, steps, anchor="first_hit") == [False, True, False, True]
