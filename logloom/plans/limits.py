"""Queries: admission control and archive flush segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators.admit import admit, limiter, split_rejected
from logloom.operators.segments import flush_segments
from logloom.plans import inputs as i
from logloom.plans.registry import query
from logloom.session import scratch
from logloom.streaming.admit import admit_stream
from logloom.streaming.closing import admit_closed, closed_verdicts

SECONDS = 10
WIDTH = SECONDS * 1_000_000
ARGS = {"ts": "arrival", "seq": "event_id", "window_seconds": SECONDS}


def _verdicts(decided):
    return decided.select("event_id", "key", F.unix_micros("window_start").alias("window_us"), "admitted")


@query(
    "limit_refill_unit",
    f"""WITH {i.REQUESTS}, o AS (SELECT *, arrival_us - arrival_us % {WIDTH} AS window_us FROM requests)
    SELECT event_id, key, window_us, row_number() OVER (PARTITION BY key, window_us ORDER BY arrival_us, event_id) <= 10 AS admitted FROM o""",
)
def limit_refill_unit(spark, sf):
    return _verdicts(admit(i.requests(spark, sf), max_tps=1, **ARGS))


_ORDERED = f"""{i.REQUESTS}, o AS (
  SELECT *, row_number() OVER (PARTITION BY key, window_us ORDER BY arrival_us, event_id) AS rn, max_tps * {SECONDS} AS quota
  FROM (SELECT *, arrival_us - arrival_us % {WIDTH} AS window_us FROM requests))"""
REFILL = f"""{_ORDERED}, fold AS (
  SELECT key, window_us, rn, event_id, CASE WHEN cost <= quota THEN quota - cost ELSE quota END AS rest, cost <= quota AS admitted
  FROM o WHERE rn = 1
  UNION ALL
  SELECT o.key, o.window_us, o.rn, o.event_id, CASE WHEN o.cost <= f.rest THEN f.rest - o.cost ELSE f.rest END, o.cost <= f.rest
  FROM fold f JOIN o ON o.key = f.key AND o.window_us = f.window_us AND o.rn = f.rn + 1)"""


def _refilled(spark, sf):
    return admit(i.requests(spark, sf), cost="cost", **limiter(" local "), **ARGS)


@query("limit_refill_batch", f"WITH RECURSIVE {REFILL} SELECT event_id, key, window_us, admitted FROM fold")
def limit_refill_batch(spark, sf):
    return _verdicts(_refilled(spark, sf))


@query(
    "limit_rejected",
    f"""WITH RECURSIVE {REFILL} SELECT r.event_id, r.topic, r.cost, 'Bandwidth Limit Exceeded' AS reject_reason
    FROM fold JOIN requests r USING (event_id) WHERE NOT admitted""",
)
def limit_rejected(spark, sf):
    return split_rejected(_refilled(spark, sf))[1].select("event_id", "topic", "cost", "reject_reason")


# The quota of a key moves while its windows run: state is carried over the whole key.
@query(
    "limit_quota_change",
    f"""WITH RECURSIVE {i.REQUESTS}, o AS (
      SELECT event_id, key, cost, arrival_us - arrival_us % {WIDTH} AS window_us, (1 + event_id // 40 % 3) * {SECONDS} AS wanted,
             row_number() OVER (PARTITION BY key ORDER BY arrival_us, event_id) AS rn FROM requests),
    fold AS (
      SELECT key, rn, event_id, window_us, wanted, CASE WHEN cost <= wanted THEN wanted - cost ELSE wanted END AS rest, cost <= wanted AS admitted
      FROM o WHERE rn = 1
      UNION ALL
      SELECT key, rn, event_id, window_us, wanted, CASE WHEN cost <= have THEN have - cost ELSE have END, cost <= have
      FROM (SELECT o.*, CASE WHEN o.window_us = f.window_us THEN f.rest ELSE f.wanted END + greatest(o.wanted - f.wanted, 0) AS have
            FROM fold f JOIN o ON o.key = f.key AND o.rn = f.rn + 1))
    SELECT event_id, key, window_us, admitted FROM fold""",
)
def limit_quota_change(spark, sf):
    quota = (1 + F.expr("event_id div 40") % 3).cast("int")
    return _verdicts(admit(i.requests(spark, sf).withColumn("max_tps", quota), cost="cost", **ARGS))


@query(
    "limit_window_counter",
    f"""WITH {_ORDERED} SELECT event_id, key, window_us,
    sum(cost) OVER (PARTITION BY key, window_us ORDER BY arrival_us, event_id) <= quota AS admitted FROM o""",
)
def limit_window_counter(spark, sf):
    return _verdicts(admit(i.requests(spark, sf), cost="cost", policy="counter", **ARGS))


# Repeated requests, and some without a time or a cost: every row keeps its place in the result.
@query(
    "limit_dirty",
    f"""WITH {i.REQUESTS}, dirty AS (
      SELECT event_id, key, max_tps, CASE WHEN event_id % 13 <> 5 THEN arrival_us END AS at_us, CASE WHEN event_id % 11 <> 3 THEN cost END AS cost
      FROM requests, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR event_id % 7 = 0),
    o AS (SELECT *, at_us - at_us % {WIDTH} AS window_us FROM dirty)
    SELECT event_id, key, window_us, at_us IS NOT NULL AND cost IS NOT NULL AND sum(coalesce(cost, 0)) OVER (
      PARTITION BY key, window_us ORDER BY at_us, event_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= max_tps * {SECONDS} AS admitted FROM o""",
)
def limit_dirty(spark, sf):
    n = F.col("event_id")
    copies = F.when(n % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dirty = i.requests(spark, sf).withColumns(
        {"arrival": F.when(n % 13 != 5, F.col("arrival")), "cost": F.when(n % 11 != 3, F.col("cost")), "copy": F.explode(copies)}
    )
    return _verdicts(admit(dirty, cost="cost", policy="counter", **ARGS))


def _first_hit(rest: str, admitted: str, start: str) -> str:
    """Fold over a key's requests; a window opens at the first hit after the last one expired."""
    return f"""WITH RECURSIVE {i.REQUESTS}, o AS (
      SELECT event_id, key, cost, arrival_us // 1000 AS ms, max_tps * {SECONDS} AS quota,
             row_number() OVER (PARTITION BY key ORDER BY arrival_us, event_id) AS rn FROM requests),
    step AS (SELECT *, ms AS opened, {start} AS have FROM o WHERE rn = 1),
    fold AS (
      SELECT key, rn, event_id, opened, {rest} AS rest, {admitted} AS admitted FROM step
      UNION ALL
      SELECT key, rn, event_id, opened, {rest}, {admitted}
      FROM (SELECT o.key, o.rn, o.event_id, o.cost, o.quota,
                   CASE WHEN o.ms >= f.opened + {SECONDS * 1000} THEN o.ms ELSE f.opened END AS opened,
                   CASE WHEN o.ms >= f.opened + {SECONDS * 1000} THEN {start.replace("quota", "o.quota")} ELSE f.rest END AS have
            FROM fold f JOIN o ON o.key = f.key AND o.rn = f.rn + 1))
    SELECT event_id, key, opened * 1000 AS window_us, admitted FROM fold"""


@query("limit_first_hit", _first_hit("CASE WHEN cost <= have THEN have - cost ELSE have END", "cost <= have", "quota"))
def limit_first_hit(spark, sf):
    return _verdicts(admit(i.requests(spark, sf), cost="cost", **limiter("gubernator"), **ARGS))


@query("limit_counter_first_hit", _first_hit("have + cost", "have + cost <= quota", "0"))
def limit_counter_first_hit(spark, sf):
    return _verdicts(admit(i.requests(spark, sf), cost="cost", **limiter("Redis"), **ARGS))


SEGMENT_BYTES, SEGMENT_SECONDS = 2000, 86_400
SEGMENTS = f"""{i.REQUESTS}, o AS (
  SELECT r.event_id, r.topic, r.bytes, epoch_us(l.ts) - epoch_us(l.ts) % {SEGMENT_SECONDS * 1_000_000} AS window_us,
         row_number() OVER (PARTITION BY r.topic, epoch_us(l.ts) // {SEGMENT_SECONDS * 1_000_000} ORDER BY l.ts, r.event_id) AS rn
  FROM requests r JOIN logs l USING (event_id)),
fold AS (
  SELECT topic, window_us, rn, event_id, bytes AS held, CAST(0 AS BIGINT) AS segment FROM o WHERE rn = 1
  UNION ALL
  SELECT o.topic, o.window_us, o.rn, o.event_id, CASE WHEN f.held >= {SEGMENT_BYTES} THEN o.bytes ELSE f.held + o.bytes END,
         CASE WHEN f.held >= {SEGMENT_BYTES} THEN f.segment + 1 ELSE f.segment END
  FROM fold f JOIN o ON o.topic = f.topic AND o.window_us = f.window_us AND o.rn = f.rn + 1)"""


def segment_lines(spark, sf):
    return i.logs(spark, sf).select("event_id", "topic", "ts", F.to_json(F.struct("topic", "timestamp", "content")).alias("line"))


def segments(spark, sf):
    lines = segment_lines(spark, sf).withColumn("bytes", F.octet_length("line"))
    return flush_segments(lines, seq="event_id", max_bytes=SEGMENT_BYTES, max_seconds=SEGMENT_SECONDS)


@query("archive_segments", f"WITH RECURSIVE {SEGMENTS} SELECT event_id, topic, window_us, segment FROM fold")
def archive_segments(spark, sf):
    return segments(spark, sf).select("event_id", "topic", F.unix_micros("flush_window").alias("window_us"), "segment")


@query("stream_admit", f"WITH RECURSIVE {REFILL} SELECT event_id, key, admitted FROM fold")
def stream_admit(spark, sf):
    """The streaming limiter over the events table, drained and read back."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    requests = i.requests_of(i.from_events(i.event_stream(spark, sf)))
    verdicts = admit_stream(requests, ts="arrival", seq="event_id", cost="cost", window_seconds=SECONDS)
    return i.drained(spark, verdicts, "stream-admit").select(F.col("seq").alias("event_id"), "key", "admitted")


@query("stream_admit_first_hit", _first_hit("CASE WHEN cost <= have THEN have - cost ELSE have END", "cost <= have", "quota").replace("opened * 1000 AS window_us, ", ""))
def stream_admit_first_hit(spark, sf):
    """The streaming limiter whose windows open at a key's first request."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    requests = i.requests_of(i.from_events(i.event_stream(spark, sf)))
    verdicts = admit_stream(requests, ts="arrival", seq="event_id", cost="cost", window_seconds=SECONDS, **limiter("gubernator"))
    return i.drained(spark, verdicts, "stream-admit").select(F.col("seq").alias("event_id"), "key", "admitted")


LATE = 3
_CLOSED = f"(SELECT max(arrival_us) - {LATE * 1_000_000} FROM requests)"


def _closing(spark, sf, name):
    requests = i.requests_of(i.from_events(i.event_stream(spark, sf)))
    out = scratch(spark, "closed")
    admit_closed(requests, f"{out}/verdicts", f"{out}/state", f"{out}/checkpoint", cost="cost", late_seconds=LATE, **limiter(name), **ARGS).awaitTermination()
    return _verdicts(closed_verdicts(spark, f"{out}/verdicts", requests.schema))


@query(
    "stream_admit_closed",
    f"WITH RECURSIVE {REFILL} SELECT event_id, key, window_us, admitted FROM fold WHERE window_us + {WIDTH} <= {_CLOSED}",
)
def stream_admit_closed(spark, sf):
    """Verdicts of the clock's windows that the watermark has passed."""
    return _closing(spark, sf, "local")


@query(
    "stream_admit_first_hit_closed",
    _first_hit("have + cost", "have + cost <= quota", "0") + f" WHERE opened * 1000 + {WIDTH} <= {_CLOSED}",
)
def stream_admit_first_hit_closed(spark, sf):
    """The same for windows that open at a key's first request, counting refused ones, too."""
    return _closing(spark, sf, "redis")


# As limit_dirty, for a bucket: every fifth quota is missing, too. What is missing changes nothing.
@query(
    "limit_dirty_refill",
    f"""WITH RECURSIVE {i.REQUESTS}, dirty AS (
      SELECT event_id, key, CASE WHEN event_id % 5 <> 2 THEN max_tps * {SECONDS} END AS quota,
        CASE WHEN event_id % 13 <> 5 THEN arrival_us END AS at_us, CASE WHEN event_id % 11 <> 3 THEN cost END AS cost FROM requests),
    o AS (SELECT *, at_us - at_us % {WIDTH} AS window_us, row_number() OVER (PARTITION BY key, at_us // {WIDTH} ORDER BY at_us, event_id) AS rn
      FROM dirty WHERE at_us IS NOT NULL AND cost IS NOT NULL AND quota IS NOT NULL),
    fold AS (
      SELECT key, window_us, rn, event_id, CASE WHEN cost <= quota THEN quota - cost ELSE quota END AS rest, cost <= quota AS admitted FROM o WHERE rn = 1
      UNION ALL
      SELECT o.key, o.window_us, o.rn, o.event_id, CASE WHEN o.cost <= f.rest THEN f.rest - o.cost ELSE f.rest END, o.cost <= f.rest
      FROM fold f JOIN o ON o.key = f.key AND o.window_us = f.window_us AND o.rn = f.rn + 1)
    SELECT event_id, key, window_us, admitted FROM fold
    UNION ALL SELECT event_id, key, at_us - at_us % {WIDTH}, false FROM dirty WHERE at_us IS NULL OR cost IS NULL OR quota IS NULL""",
)
def limit_dirty_refill(spark, sf):
    n = F.col("event_id")
    dirty = i.requests(spark, sf).withColumns(
        {"arrival": F.when(n % 13 != 5, F.col("arrival")), "cost": F.when(n % 11 != 3, F.col("cost")), "max_tps": F.when(n % 5 != 2, F.col("max_tps"))}
    )
    return _verdicts(admit(dirty, cost="cost", **ARGS))
