"""Admission on a stream, answered when a window closes: exact, in any order of arrival, without Python state.

Each micro-batch decides the windows that the watermark has passed, with the batch operator, so a hot key
is split and a window's order is that of its times whatever the order of arrival. What is still open
waits in a table of the narrow kind: requests of the last window and of the allowed lateness. State,
verdicts and watermark of a micro-batch lie in folders named by its number, and it reads only those of the
one before; a micro-batch that runs again replaces what it wrote, so a restart changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.operators.admit import admit
from logloom.session import stored


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class ClosedWindows:
    """One micro-batch after the other; see ``admit_closed``."""

    def __init__(self, path: str, state: str, *, key, ts, seq, cost, max_tps, window_seconds, policy, anchor, late_seconds):
        self._path, self._state = path.rstrip("/"), state.rstrip("/")
        self._key, self._ts, self._seq, self._cost, self._quota = key, ts, seq, cost, max_tps
        self._options = {"key": key, "ts": ts, "seq": seq, "cost": cost, "max_tps": max_tps, "window_seconds": window_seconds, "policy": policy, "anchor": anchor}
        self._width, self._late, self._tick = window_seconds * 1_000_000, late_seconds * 1_000_000, anchor == "tick"
        #: Only here does a window depend on the one before it: by the quota that filled the bucket.
        self._carries = self._tick and policy == "refill" and not isinstance(max_tps, int)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            self._run(batch, batch_id)
        finally:
            batch.unpersist()
        _forget(batch.sparkSession, f"{self._state}/batch_id={batch_id - 2}")

    def _run(self, batch: DataFrame, batch_id: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        before = f"{self._state}/batch_id={batch_id - 1}"
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{before}/{name}")
        passed = read("mark", "mark bigint").first()["mark"] if batch_id else None  # the highest time seen so far
        us = F.unix_micros(F.col(self._ts))
        known = us.isNotNull()
        for needed in ([] if self._cost is None else [self._cost]) + ([] if isinstance(self._quota, int) else [self._quota]):
            known = known & F.col(needed).isNotNull()
        seen = batch.filter(known).agg(F.max(us)).first()[0]
        mark = max((m for m in (passed, seen) if m is not None), default=None)
        closed_until = self._until(passed)
        late = F.lit(False) if closed_until is None else us < closed_until
        waiting = batch.filter(known & ~late)
        if batch_id:
            waiting = waiting.unionByName(read("pending", batch.schema))
        carried = read("carried", self._carry_schema(batch)) if batch_id and self._carries else None
        verdicts, pending, kept = self._decide(waiting, carried, mark)
        refused = batch.filter(~known | late).withColumns(
            {"window_start": F.when(F.lit(self._tick), F.timestamp_micros(us - F.pmod(us, F.lit(self._width)))), "admitted": F.lit(False), "late": known & late}
        )
        out = verdicts.withColumn("late", F.lit(False)).select(*columns, "window_start", "admitted", "late").unionByName(refused)
        _write(out, f"{self._path}/batch_id={batch_id}")
        here = f"{self._state}/batch_id={batch_id}"
        _write(pending.select(*columns), f"{here}/pending")
        if self._carries:
            _write(kept, f"{here}/carried")
        _write(spark.createDataFrame([(mark,)], "mark bigint"), f"{here}/mark")

    def _until(self, mark: int | None) -> int | None:
        """Requests before this time are late: they would change what is decided already."""
        if mark is None:
            return None
        passed = mark - self._late
        return passed - passed % self._width if self._tick else passed

    def _carry_schema(self, batch: DataFrame) -> str:
        kinds = {c: batch.schema[c].dataType.simpleString() for c in (self._key, self._ts, self._seq, self._quota)}
        return ", ".join(f"`{c}` {k}" for c, k in kinds.items())

    def _decide(self, waiting: DataFrame, carried: DataFrame | None, mark: int | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """(verdicts of closed windows, requests of open ones, each key's last quota)."""
        passed = F.lit(None).cast("bigint") if mark is None else F.lit(mark - self._late)
        is_closed = lambda opened: F.coalesce(opened + self._width <= passed, F.lit(False))
        if not self._tick:
            decided = stored(admit(waiting, **self._options), "decided")
            closed = is_closed(F.unix_micros("window_start"))
            return decided.filter(closed), decided.filter(~closed), None
        us = F.unix_micros(F.col(self._ts))
        closed = is_closed(us - F.pmod(us, F.lit(self._width)))
        asked = waiting.filter(closed).withColumn("_carried", F.lit(False))
        kept = None
        if self._carries:
            names = [self._key, self._ts, self._seq, self._quota]
            if carried is not None:
                # a request that costs nothing in the window before says what filled the bucket
                free = carried.withColumn("_carried", F.lit(True))
                if self._cost is not None:
                    free = free.withColumn(self._cost, F.lit(0).cast(waiting.schema[self._cost].dataType))
                asked = asked.unionByName(free, allowMissingColumns=True)
            last = F.max_by(F.struct(*names), F.struct(self._ts, self._seq)).alias("last")
            kept = asked.groupBy(F.col(self._key).alias("_k")).agg(last).select("last.*")
        verdicts = admit(asked, **self._options).filter("NOT _carried").drop("_carried")
        return verdicts, waiting.filter(~closed), kept


def admit_closed(
    requests: DataFrame,
    path: str,
    state: str,
    checkpoint: str,
    *,
    key: str = "key",
    ts: str = "ts",
    seq: str = "seq",
    cost: str | None = None,
    max_tps: str | int = "max_tps",
    window_seconds: int = 10,
    policy: str = "refill",
    anchor: str = "tick",
    late_seconds: int = 0,
    every: str | None = None,
) -> StreamingQuery:
    """Requests with ``window_start``, ``admitted`` and ``late``, written to ``path`` once their window is closed.

    A window is closed when the highest time seen is ``late_seconds`` past its end. The verdicts of closed
    windows equal those of ``admit`` over all requests that came in time. A request for a closed window
    (of a first-hit limiter: one before the watermark) is refused and marked late; one without a time,
    cost or quota is refused at once and changes nothing. Windows that never close stay in ``state``.
    """
    run = ClosedWindows(path, state, key=key, ts=ts, seq=seq, cost=cost, max_tps=max_tps, window_seconds=window_seconds, policy=policy, anchor=anchor, late_seconds=late_seconds)
    writer = requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def closed_verdicts(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``admit_closed`` has written; ``schema`` is that of the requests."""
    added = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", window_start timestamp, admitted boolean, late boolean"
    return spark.read.schema(added).parquet(path)

