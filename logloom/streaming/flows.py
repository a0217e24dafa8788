"""Structured Streaming forms of the flows. State and progress live in the query's checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.operators.meter import count_by
from logloom.plans.flows import to_archive, to_index
from logloom.sinks.flushes import write_flushes
from logloom.sinks.tables import write_archive, write_dead_letters, write_index


def _trigger(writer, every: str | None):
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def split_errors_kept(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and failed rows with their error."""
    return made.filter("error IS NULL"), made.filter("error IS NOT NULL")


@dataclass(frozen=True)
class Hooks:
    """What a flow calls or writes after each micro-batch.

    ``on_success(counts)`` and ``on_error(batch_id, error)`` are functions; ``counters`` is a table of the
    counts, a folder per micro-batch, replaced by a replay. The counts come from the pass that makes the
    rows, not from a second one: records, stored and failed ones, bytes stored. An error is raised again
    after its hook, so the stream stops where it was.
    """

    on_success: Callable[[dict], None] | None = None
    on_error: Callable[[int, Exception], None] | None = None
    counters: str | None = None


@contextmanager
def _counted(made: DataFrame, column: str, batch_id: int, hooks: Hooks | None):
    """``made``, counted while it is computed and kept for two writes."""
    if hooks is None:
        kept, seen = made.persist(), None
    else:
        seen = Observation(f"flow-{uuid.uuid4().hex}")
        good = F.col("error").isNull()
        counts = [F.count(F.lit(1)).alias("records"), F.count_if(good).alias("stored"), F.count_if(~good).alias("failed")]
        kept = made.observe(seen, *counts, F.coalesce(F.sum(F.when(good, F.octet_length(column))), F.lit(0)).alias("bytes")).persist()
    try:
        yield kept
        if hooks is not None:
            found = {"batch_id": batch_id, **seen.get}
            if hooks.counters:
                row = made.sparkSession.createDataFrame([tuple(found[c] for c in ("records", "stored", "failed", "bytes"))], "records bigint, stored bigint, failed bigint, bytes bigint")
                row.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{hooks.counters}/batch_id={batch_id}")
            if hooks.on_success:
                hooks.on_success(found)
    except Exception as error:
        if hooks is not None and hooks.on_error:
            hooks.on_error(batch_id, error)
        raise
    finally:
        kept.unpersist()


def index_stream(
    messages: DataFrame, path: str, dead_letters: str, checkpoint: str, rules, *, every: str | None = None, clock=None,
    data_stream: bool = False, content_schema=None, hooks: Hooks | None = None,
) -> StreamingQuery:
    """Messages to an index table, failures to a dead-letter table.

    ``rules`` is what ``to_index`` takes, or ``LiveRules`` whose ``refresh`` runs before each micro-batch. A batch
    that is replayed after a failure replaces all it had written, so nothing is stored twice. A dead
    letter keeps the message, so it can be replayed.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        current = rules.refresh() if hasattr(rules, "refresh") else rules
        with _counted(to_index(batch, current, clock, data_stream=data_stream, content_schema=content_schema), "document", batch_id, hooks) as made:
            good, bad = split_errors_kept(made)
            write_index(good, path, batch_id)
            write_dead_letters(bad, dead_letters, batch_id)

    writer = messages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def archive_stream(
    messages: DataFrame, path: str, checkpoint: str, *, every: str | None = None, compression: str = "gzip", simple: bool = True,
    dead_letters: str | None = None, flush_bytes: int | None = None, flush_seconds: int = 3600, ts: str = "ts", seq: str = "event_id", on_flush=None,
    hooks: Hooks | None = None,
) -> StreamingQuery:
    """Messages to compressed text per topic; each micro-batch has a folder, which a replay replaces.

    The trigger interval is the flush time; ``maxBytesPerTrigger`` on the source is the flush size. With
    ``flush_bytes`` a micro-batch is cut into flushes by (``ts``, ``seq``), one object each, listed in a
    manifest (``sinks.flushes``). Messages that failed go, with what is needed to replay them, to the table
    ``dead_letters``, or to ``path/_dead_letters``, which readers of the archive do not see.
    """
    dead = dead_letters or f"{path.rstrip('/')}/_dead_letters"

    def store(batch: DataFrame, batch_id: int) -> None:
        with _counted(to_archive(batch, simple=simple), "line", batch_id, hooks) as made:
            good, bad = split_errors_kept(made)
            if flush_bytes is None:
                write_archive(good, f"{path}/batch_id={batch_id}", compression, mode="overwrite")
            else:
                write_flushes(good, path, batch_id, ts=ts, seq=seq, compression=compression, max_bytes=flush_bytes, max_seconds=flush_seconds, on_flush=on_flush)
            write_dead_letters(bad, dead, batch_id)

    return _trigger(messages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint), every).start()


def count_stream(logs: DataFrame, *labels: str, every: str = "1 hour", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Windowed counts on a stream; a window is emitted once the watermark has passed it."""
    return count_by(logs.withWatermark(ts, late), *labels, every=every, ts=ts)


def topic_stream(logs: DataFrame, topic: str = "topic") -> DataFrame:
    """Each topic once, when it is first seen."""
    return logs.select(topic).dropDuplicates([topic])
