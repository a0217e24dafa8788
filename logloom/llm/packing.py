"""Best-fit packing with dominance reduction.

Sequences hold at most ``capacity`` ids, so a packing depends on the texts only through how many
pieces there are of each length: at most ``capacity`` counts, whatever the corpus. Those counts are
packed on the driver; Spark cuts documents into pieces, counts them, and looks each piece's place up.

Reduction (Martello and Toth): take a piece of the longest length left. If no other piece fits beside
it, or the set chosen dominates every other set that contains it, that set is in some best packing and
is fixed: the largest partner when it fills the sequence, when at most one partner fits, or when it is
no smaller than any pair that fits; a largest partner with the best third piece when no fitting pair has
a larger second piece. Equal pieces are fixed at once, as often as the lengths allow. What remains is
packed best-fit in descending length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.text import whole
from logloom.llm.tokenizing import SpacedEncoder, list_column, per_worker, read_tokenizer
from logloom.session import stored

#: The longest sequence and the id that ends a document.
CAPACITY = 4096
END_ID = 1

#: A shape of sequence: how many sequences have it, and its (length, copies) in order.
Shape = tuple[int, tuple[tuple[int, int], ...]]


class _Counts:
    """Pieces left by length."""

    def __init__(self, counts: dict[int, int]):
        self.n = {length: c for length, c in counts.items() if c > 0}
        self.lengths = sorted(self.n)

    def take(self, length: int, copies: int) -> None:
        self.n[length] -= copies
        if not self.n[length]:
            del self.n[length]
            del self.lengths[bisect_left(self.lengths, length)]

    def at_most(self, room: int, without: tuple[int, ...] = ()) -> int:
        """The largest length of at most ``room`` when one piece of each of ``without`` is away; 0 if none."""
        i = bisect_left(self.lengths, room + 1) - 1
        while i >= 0 and self.n[self.lengths[i]] <= without.count(self.lengths[i]):
            i -= 1
        return self.lengths[i] if i >= 0 else 0

    def smallest(self, copies: int, without: int) -> list[int]:
        """The ``copies`` smallest pieces beside one of length ``without``."""
        found: list[int] = []
        for length in self.lengths:
            found += [length] * min(copies - len(found), self.n[length] - (length == without))
            if len(found) == copies:
                break
        return found

    def best_pair(self, room: int, without: int) -> int:
        """The largest sum of two pieces within ``room``; 0 if no two fit."""
        best = 0
        for a in reversed(self.lengths[: bisect_left(self.lengths, room)]):
            if 2 * a <= best:
                break
            if self.n[a] > (a == without) and (b := self.at_most(min(a, room - a), (without, a))):
                best = max(best, a + b)
        return best


def _dominating(left: _Counts, length: int, capacity: int) -> tuple[int, ...] | None:
    """The lengths to put beside a piece of ``length``, or None if none provably dominate."""
    room = capacity - length
    first = left.at_most(room, (length,))
    if not first:
        return ()
    if first == room:
        return (first,)
    few = left.smallest(3, length)
    if len(few) < 2 or sum(few[:2]) > room:
        return (first,)
    if len(few) < 3 or sum(few) > room:
        if first >= left.best_pair(room, length):
            return (first,)
        second = left.at_most(room - first, (length, first))
        # a fitting pair's smaller piece is at most half the room
        if second and second >= left.at_most(min(room // 2, first), (length, first)):
            return (first, second)
    return None


def reduce_counts(counts: dict[int, int], capacity: int) -> tuple[list[Shape], dict[int, int]]:
    """Shapes that some best packing has, and the counts left; one pass in descending length."""
    left, shapes = _Counts(counts), []
    at = len(left.lengths) - 1
    length = left.lengths[at] if at >= 0 else 0
    while length:
        while left.n.get(length) and (beside := _dominating(left, length, capacity)) is not None:
            pieces = (length, *beside)
            times = min(left.n[x] // pieces.count(x) for x in set(pieces))
            for x in set(pieces):
                left.take(x, times * pieces.count(x))
            shapes.append((times, tuple((x, pieces.count(x)) for x in sorted(set(pieces), reverse=True))))
        length = left.at_most(length - 1)
    return shapes, left.n


def best_fit(counts: dict[int, int], capacity: int) -> list[Shape]:
    """Best-fit in descending length, sequences of one content handled together."""
    open_: dict[int, list[list]] = {}  # room -> [[sequences, contents], ...]
    rooms: list[int] = []
    shapes: list[Shape] = []

    def put(room: int, times: int, contents: tuple) -> None:
        if not room:
            shapes.append((times, contents))
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([times, contents])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                put(capacity, -(-left // (capacity // length)), ())
                continue
            room = rooms[i]
            times, contents = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[i]
            copies = room // length
            full = min(times, left // copies)
            if full:
                put(room - copies * length, full, (*contents, (length, copies)))
                left -= full * copies
            times -= full
            if times and left:
                put(room - left * length, 1, (*contents, (length, left)))
                left, times = 0, times - 1
            if times:
                put(room, times, contents)
    return shapes + [(times, contents) for groups in open_.values() for times, contents in groups]


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[Shape]:
    shapes, left = reduce_counts(counts, capacity)
    return [s for s in shapes + best_fit(left, capacity) if s[0]]


class _Places:
    """The place of the n-th piece of each length."""

    def __init__(self, shapes: list[Shape]):
        rows: dict[int, list] = {}
        base = 0
        for times, contents in shapes:
            offset = 0
            for length, copies in contents:
                rows.setdefault(length, []).append((times * copies, copies, base, offset))
                offset += length * copies
            base += times
        self.rows = {}
        for length, found in rows.items():
            table = np.array(found, dtype=np.int64)
            ends = np.cumsum(table[:, 0])
            self.rows[length] = (ends, ends - table[:, 0], table[:, 1], table[:, 2], table[:, 3])

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for rows in np.split(order, cuts) if len(order) else []:
            length = int(lengths[rows[0]])
            ends, begins, copies, base, offsets = self.rows[length]
            at = np.searchsorted(ends, ranks[rows], side="right")
            inside = ranks[rows] - begins[at]
            sequence[rows] = base[at] + inside // copies[at]
            offset[rows] = offsets[at] + inside % copies[at] * length
        return sequence, offset


def cut_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, rank (its number among its partition's pieces of that length), and ids if asked."""
    source = read_tokenizer(docs.sparkSession, tokenizer_path)
    tail = np.asarray([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def run(batches):
        encoder = per_worker(SpacedEncoder, source.value)
        seen: dict[int, int] = {}
        for batch in batches:
            of, piece, crc, rank, ids = [], [], [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                data = encoder.encode(t) + tail
                for n, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    of.append(row)
                    piece.append(n)
                    crc.append(zlib.crc32(part))
                    ids.append(part)
                    rank.append(seen.get(len(part), 0))
                    seen[len(part)] = rank[-1] + 1
            pieces, lengths = np.array(piece, dtype=np.int32), np.array([len(i) // 4 for i in ids], dtype=np.int64)
            columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(pieces), pa.array(pieces.astype(np.int64) * capacity), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(rank, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *([list_column(ids)] if with_ids else [])], ["k", "piece", "start", "length", "ids_crc32", "rank", *(["ids"] if with_ids else [])])

    narrow = docs.select(F.col(key).alias("k"), whole(F.col(text)).alias("t"))
    kind = narrow.schema["k"].dataType.simpleString()
    return narrow.mapInArrow(run, f"k {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, rank bigint" + ", ids array<int>" * with_ids).withColumnRenamed("k", key)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place every piece: its columns but ``rank``, and sequence_id and offset.

    The pieces are stored first, so a lost executor cannot renumber them. Numbers within a length run
    over the stored parts: per (part, length) counts are summed, never the pieces themselves.
    """
    spark = pieces.sparkSession
    kept = stored(pieces.withColumn("part", F.spark_partition_id()), "pieces")
    counts = kept.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(_Places(pack_counts(totals, capacity)))
    columns = [c for c in kept.columns if c not in ("rank", "part")]

    def run(batches):
        for batch in batches:
            sequence, offset = places.value.of(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    numbered = kept.join(bases, ["part", "length"]).withColumn("number", F.col("rank") + F.col("base")).select(*columns, "number")
    kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in columns)
    return numbered.mapInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every text (null: empty, which is the end id alone) in as few sequences as found.

    Only documents longer than ``capacity`` are cut. Repeated rows and null keys are packed like any
    others; an empty table packs nothing; other columns are ignored.
    """
    return pack(cut_documents(docs, tokenizer_path, capacity, end_id, with_ids, key, text), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, from pieces packed ``with_ids``; a group has at most ``capacity`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
