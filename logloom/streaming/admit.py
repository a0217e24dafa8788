"""Admission on a stream with immediate answers, one small state per key."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_FIELDS = 6  # of a request: ts, seq, whether it has a seq, cost, quota, known
_WAITING = 1 << 17  # requests in memory
_STATE = T.StructType([T.StructField(n, T.LongType()) for n in ("window", "quota", "used", "last")])


def _sorted(parts: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate(parts)
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def _by_time(frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """A key's requests in order of (ts, seq), equal ones as they came, in blocks of ``_WAITING`` at most.

    Sorted runs of so many wait in a temporary file and are merged; requests that fit memory touch no disk.
    """
    size = 8 * _FIELDS
    with tempfile.SpooledTemporaryFile(_WAITING * size) as file:
        held, count, unread, end = [], 0, [], 0  # unread: where each run goes on, where it ends
        for frame in frames:
            held.append(frame.iloc[:, 1:].to_numpy(np.int64))
            count += len(frame)
            if count >= _WAITING:
                end += file.write(_sorted(held).tobytes())
                unread.append([end - count * size, end])
                held, count = [], 0
        if held:  # the last run stays in memory
            unread.append([end, end])
        share = max(_WAITING // max(len(unread), 1), 1)
        ahead = [np.empty((0, _FIELDS), np.int64)] * len(unread)
        if held:
            ahead[-1] = _sorted(held)
            del held
        while True:
            for n, (at, stop) in enumerate(unread):
                if at < stop and not len(ahead[n]):
                    file.seek(at)
                    ahead[n] = np.frombuffer(file.read(min(share * size, stop - at)), np.int64).reshape(-1, _FIELDS)
                    unread[n][0] += ahead[n].nbytes
            # nothing unread comes before the last row read of its run
            known = min(((*ahead[n][-1, :2].tolist(), n) for n, (at, stop) in enumerate(unread) if at < stop), default=None)
            ready = [len(rows) if known is None else _until(rows, known, n) for n, rows in enumerate(ahead)]
            if not sum(ready):
                return
            block = _sorted([rows[:n] for rows, n in zip(ahead, ready, strict=True)])
            ahead = [rows[n:] for rows, n in zip(ahead, ready, strict=True)]
            yield from (block[n : n + _WAITING] for n in range(0, len(block), _WAITING))


def _until(rows: np.ndarray, known: tuple[int, int, int], run: int) -> int:
    """How many sorted rows come before ``known``, or are equal to it and not of a later run."""
    ts, seq, of = known
    low, high = np.searchsorted(rows[:, 0], [ts, ts + 1])
    return int(low + np.searchsorted(rows[low:high, 1], seq, "right" if run <= of else "left"))


class Bucket(StatefulProcessor):
    """Window, quota and tokens of one key; requests are taken in order of (ts, seq) within a
    micro-batch, however its rows are cut into Arrow batches. A late request counts against the
    current window. However many requests a key has, a block of them is in memory."""

    def __init__(self, window_seconds: int, policy: str, anchor: str, idle_seconds: int | None):
        self._width = window_seconds * 1_000_000
        self._policy, self._anchor, self._idle = policy, anchor, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("bucket", _STATE, ttlDurationMs=self._idle and self._idle * 1000)

    def handleInputRows(self, key, rows, timerValues):
        state = tuple(self._state.get()) if self._state.exists() else None
        for block in _by_time(rows):
            verdicts = []
            for at, _, _, cost, quota, known in block.tolist():
                verdict = False  # without a time, cost or quota: refused, and nothing changes
                if known:
                    state, verdict = self._take(state, at, cost, quota)
                verdicts.append(verdict)
            seq = pd.Series(block[:, 1], dtype="Int64").mask(block[:, 2] == 0)
            yield pd.DataFrame({"key": key[0], "seq": seq, "cost": block[:, 3], "admitted": verdicts})
        if state is not None:
            self._state.update(state)

    def _take(self, state, at: int, cost: int, quota: int):
        tick = self._anchor == "tick"
        if state is None:
            state = (at - at % self._width if tick else at - at % 1000, quota, 0, quota)
        window, held, used, last = state
        if at >= window + self._width:
            window = at - at % self._width if tick else at - at % 1000
            held, used = (last if tick else quota), 0
            last = held
        if self._policy == "counter":
            used += cost
            return (window, quota, used, quota), used <= quota
        if quota > last:
            held += quota - last
        admitted = used + cost <= held
        return (window, held, used + cost if admitted else used, quota), admitted

    def close(self) -> None:
        pass


def admit_stream(
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
    idle_seconds: int | None = None,
) -> DataFrame:
    """Streaming ``admit``: ``key, seq, cost, admitted``. Needs the RocksDB state store.

    Requests without a time, cost or quota are refused and change nothing; a missing cost is given as 0.
    The state of a key is four numbers. With ``idle_seconds`` it is dropped after that long without
    a request; such a query keeps checking the clock, so it suits a processing-time trigger and
    never drains.
    """
    quota = (F.lit(max_tps) if isinstance(max_tps, int) else F.col(max_tps)).cast("long") * window_seconds
    at, number, price = F.unix_micros(F.col(ts)), F.col(seq).cast("long"), (F.lit(1) if cost is None else F.col(cost)).cast("long")
    rows = requests.select(  # no nulls among numbers: pandas would make them all floats
        F.col(key).alias("_key"),
        F.coalesce(at, F.lit(0)).alias("_ts"),
        F.coalesce(number, F.lit(2**63 - 1)).alias("_seq"),  # those without a number come last
        number.isNotNull().cast("long").alias("_numbered"),
        F.coalesce(price, F.lit(0)).alias("_cost"),
        F.coalesce(quota, F.lit(0)).alias("_quota"),
        (at.isNotNull() & price.isNotNull() & quota.isNotNull()).cast("long").alias("_known"),
    )
    out = T.StructType(
        [
            T.StructField("key", requests.schema[key].dataType),
            T.StructField("seq", T.LongType()),
            T.StructField("cost", T.LongType()),
            T.StructField("admitted", T.BooleanType()),
        ]
    )
    return rows.groupBy("_key").transformWithStateInPandas(
        Bucket(window_seconds, policy, anchor, idle_seconds), out, "Append", "None" if idle_seconds is None else "ProcessingTime"
    )
