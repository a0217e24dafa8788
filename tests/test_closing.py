"""Streaming admission at window close against batch admission, over many micro-batches, late rows and restarts."""

import random
import tracemalloc
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logloom.operators.admit import admit
from logloom.streaming import admit as streaming_admit
from logloom.streaming.admit import Bucket, admit_stream
from logloom.streaming.closing import ClosedWindows, admit_closed, closed_verdicts

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "key string, ts timestamp, seq long, cost int, max_tps int"
WINDOW, LATE = 5, 4
NAMES = {"key": "key", "ts": "ts", "seq": "seq", "cost": "cost", "max_tps": "max_tps", "window_seconds": WINDOW, "late_seconds": LATE}


def arrivals(seed, files=5, count=700, moving=True):
    """Files of requests, a hot key, jitter within the lateness, nulls; a few requests come far too late."""
    source = random.Random(seed)
    made = [[] for _ in range(files)]
    for n in range(count):
        at = source.randrange(0, 60_000)
        key = "hot" if source.random() < 0.5 else source.choice(["a", "b", None])
        tps = (1 + at // 7000 % 3 if moving else 2) * 4
        row = (key, START + timedelta(milliseconds=at), n, source.choice([0, 1, 2, 7]), tps)
        if n % 50 == 7:
            row = (key, None if n % 3 == 0 else row[1], n, None if n % 3 == 1 else 1, None if n % 3 == 2 else tps)
        file = min(files - 1, max(0, (at + source.randrange(-1500, 1500)) * files // 60_000))
        made[files - 1 if n % 97 == 5 and file < files - 3 else file].append(row)
    return made


def known(row):
    return None not in (row[1], row[3], row[4])


def in_time(files, anchor):
    """The requests that are not late, in the order of their files."""
    kept, mark = [], None
    for rows in files:
        passed = None if mark is None else mark - timedelta(seconds=LATE)
        if passed is not None and anchor == "tick":
            passed = START + (passed - START) // timedelta(seconds=WINDOW) * timedelta(seconds=WINDOW)
        kept += [r for r in rows if known(r) and (passed is None or r[1] >= passed)]
        mark = max([r[1] for r in rows if known(r)] + ([mark] if mark else []))
    return kept, mark


def batches(spark, files):
    return [spark.createDataFrame(rows, SCHEMA) for rows in files]


@pytest.mark.parametrize("anchor", ["tick", "first_hit"])
@pytest.mark.parametrize("policy", ["refill", "counter"])
def test_closed_windows_equal_batch(spark, tmp_path, policy, anchor):
    files = arrivals(3)
    run = ClosedWindows(f"{tmp_path}/out", f"{tmp_path}/state", **NAMES, policy=policy, anchor=anchor)
    for n, frame in enumerate(batches(spark, files)):
        run(frame, n)
        if n == 2:  # the same micro-batch again, as after a failure
            run(frame, n)
    found = closed_verdicts(spark, f"{tmp_path}/out", frame.schema).collect()
    assert len({r["seq"] for r in found}) == len(found)
    punctual, mark = in_time(files, anchor)
    wanted = {
        r["seq"]: (r["window_start"], r["admitted"])
        for r in admit(spark.createDataFrame(punctual, SCHEMA), cost="cost", window_seconds=WINDOW, policy=policy, anchor=anchor).collect()
        if r["window_start"].replace(tzinfo=timezone.utc) + timedelta(seconds=WINDOW) <= mark - timedelta(seconds=LATE)
    }
    assert {r["seq"]: (r["window_start"], r["admitted"]) for r in found if not r["late"] and known((0, r["ts"], 0, r["cost"], r["max_tps"]))} == wanted
    every = [r for rows in files for r in rows]
    late = {r[2] for r in every if known(r)} - {r[2] for r in punctual}
    assert late and {r["seq"] for r in found if r["late"]} == late and not any(r["admitted"] for r in found if r["late"])
    assert {r["seq"] for r in found if r["seq"] not in wanted and r["seq"] not in late} == {r[2] for r in every if not known(r)}
    assert 50 < sum(a for _, a in wanted.values()) < len(wanted)


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    files = arrivals(5, moving=False)
    args = dict(cost="cost", window_seconds=WINDOW, late_seconds=LATE)
    for n, frame in enumerate(batches(spark, files)):
        frame.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(frame.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        admit_closed(stream, f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/checkpoint", **args).awaitTermination()
    found = {r["seq"]: r["admitted"] for r in closed_verdicts(spark, f"{tmp_path}/out", frame.schema).filter("NOT late AND cost IS NOT NULL AND max_tps IS NOT NULL AND ts IS NOT NULL").collect()}
    punctual, _ = in_time(files, "tick")
    batch = {r["seq"]: r["admitted"] for r in admit(spark.createDataFrame(punctual, SCHEMA), cost="cost", window_seconds=WINDOW).collect()}
    assert len(found) > 400 and all(batch[s] == a for s, a in found.items())
    assert len([p for p in (tmp_path / "state").iterdir()]) == 2  # older states are gone


@pytest.mark.parametrize("anchor", ["tick", "first_hit"])
def test_nulls_do_not_end_the_immediate_stream(spark, tmp_path, anchor):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("k", START + timedelta(milliseconds=n), n, 1, 1) for n in range(5)]
    rows += [("k", None, 5, 1, 1), ("k", START + timedelta(milliseconds=6), 6, None, 1), ("k", START + timedelta(milliseconds=7), 7, 1, None)]
    rows += [("k", START + timedelta(milliseconds=8 + n), 8 + n, 1, 1) for n in range(5)]
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = admit_stream(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), cost="cost", window_seconds=WINDOW, anchor=anchor)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {r["seq"]: r["admitted"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {n: n < 5 for n in range(13)}
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.count("*")).first()[0] == 13


class Held:
    """A state of one key, in memory."""

    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def frames(ts, seq, cost, size=512):
    rows = pd.DataFrame({"key": "k", "ts": ts, "seq": seq, "numbered": 1, "cost": cost, "quota": 40, "known": 1})
    return (rows[n : n + size] for n in range(0, len(rows), size))


@pytest.mark.parametrize("waiting", [7, 100, 5000])
def test_requests_that_wait_in_files_are_taken_in_order(monkeypatch, waiting):
    monkeypatch.setattr(streaming_admit, "_WAITING", waiting)
    source = np.random.default_rng(waiting)
    ts, seq, cost = source.integers(0, 60, 3000) * 1_000_000, source.integers(0, 9, 3000), source.integers(1, 9, 3000)
    bucket = Bucket(WINDOW, "refill", "first_hit", None)
    bucket._state = Held()
    found = list(bucket.handleInputRows(("k",), frames(ts, seq, cost, 11), None))
    order, state, wanted = np.lexsort((seq, ts)), None, []
    for n in order:
        state, verdict = bucket._take(state, int(ts[n]), int(cost[n]), 40)
        wanted.append((int(seq[n]), int(cost[n]), verdict))
    assert [tuple(r) for f in found for r in f[["seq", "cost", "admitted"]].itertuples(index=False)] == wanted
    assert bucket._state.value == state and max(map(len, found)) <= waiting


def test_memory_of_a_hot_key_is_bounded():
    ts = np.random.default_rng(1).integers(0, 10**9, 600_000)
    made = frames(ts, np.arange(len(ts)), 1)
    bucket = Bucket(WINDOW, "refill", "first_hit", None)
    bucket._state = Held()
    tracemalloc.start()
    try:
        assert sum(len(f) for f in bucket.handleInputRows(("k",), made, None)) == len(ts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60 << 20, peak
