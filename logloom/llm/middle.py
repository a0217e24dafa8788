"""Fill-in-middle: a text is cut into prefix, middle and suffix at unit boundaries.

The characters of a batch of texts become classes (letter, digit, space ...; a bit marks the last of a
run of one class) in a wavelet matrix: one bit vector per bit of a class, each with a stable partition
by that bit. It answers how many characters of a class stand before a place (rank) in one step per
bit. Ranks of the classes that end a unit add up to the number of unit boundaries before a place;
bisection on that count finds the cuts, for all texts of the batch at once. Classes are kept in three
bits and the mark in a fourth, so the matrix takes well under a byte per character.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.text import whole
from logloom.llm.tokenizing import per_worker

SPACE, LINE_END, LETTER, DIGIT, MARK, PUNCTUATION, SYMBOL, OTHER = range(8)
#: Bit of a symbol that says the next character is of another class.
LAST = 8
BITS = 4
#: The symbols after which a unit ends.
UNITS = {
    "character": tuple(range(16)),
    "word": (LETTER + LAST, DIGIT + LAST),
    "line": (LINE_END, LINE_END + LAST),
}
#: Characters of the texts that share one matrix; a longer text has one of its own.
MATRIX_CHARS = 1 << 20


@dataclass(frozen=True)
class Markers:
    """What stands before prefix, suffix and middle, and how often a text stays plain or gets its suffix first (percent)."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    cut_percent: int = 90
    spm_percent: int = 20

    def __post_init__(self):
        names = (self.prefix, self.suffix, self.middle)
        if len({n[:1] for n in names}) != 1 or any(n.find(names[0][0], 1) >= 0 for n in names) or len(set(names)) < 3:
            raise ValueError("markers must differ, start with one character and hold it nowhere else")

    def pattern(self) -> str:
        """Matches a marker, in Java and Python alike."""
        return "|".join(re.sub(r"([^A-Za-z0-9])", r"\\\1", n) for n in (self.prefix, self.suffix, self.middle))


class Classes:
    """Class of every code point, by a rule over general categories."""

    def __init__(self):
        kinds = {"L": LETTER, "N": DIGIT, "M": MARK, "P": PUNCTUATION, "S": SYMBOL, "Z": SPACE}
        self.table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        for c in "\t\x0b\x0c\r":
            self.table[ord(c)] = SPACE
        for c in "\n\x85\u2028\u2029":
            self.table[ord(c)] = LINE_END

    def symbols(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Symbol of each character; the last character of a text ends a run."""
        found = self.table[points]
        last = np.ones(len(found), dtype=bool)
        last[:-1] = found[1:] != found[:-1]
        last[starts[(starts > 0) & (starts <= len(last))] - 1] = True
        return found | (last * np.uint8(LAST))


class WaveletMatrix:
    """Ranks of symbols below 2^bits over a sequence."""

    def __init__(self, symbols: np.ndarray, bits: int = BITS):
        self.length, self.bits, self.levels = len(symbols), bits, []
        for b in range(bits - 1, -1, -1):
            ones = (symbols >> b & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(ones) // 64 + 1, dtype=np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), dtype=np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((words, before, self.length - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        words, before, _ = self.levels[level]
        word = at >> 6
        inside = words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return before[word] + np.bitwise_count(inside)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each place."""
        start, end = np.zeros_like(at), at
        for level in range(self.bits):
            zeros = self.levels[level][2]
            if symbol >> (self.bits - 1 - level) & 1:
                start, end = zeros + self._ones(level, start), zeros + self._ones(level, end)
            else:
                start, end = start - self._ones(level, start), end - self._ones(level, end)
        return end - start

    def boundaries(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """How many units end before each place: the ranks of all symbols that end one, added up."""
        return np.sum([self.rank(s, at) for s in symbols], axis=0)

    def place(self, symbols: tuple[int, ...], count: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest places from ``low`` to ``high`` before which ``count`` units end, by bisection on ranks."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self.boundaries(symbols, middle) >= count
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low


def cuts(texts: list[str], first: np.ndarray, second: np.ndarray, unit: str, classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, end of prefix, end of middle) of texts of one matrix; the cuts come after so many units.

    ``first`` and ``second`` are taken modulo the number of units and one. What stands behind the last
    unit belongs to it; a text that has characters but ends no unit is one unit.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    matrix, ending = WaveletMatrix(classes.symbols(points, starts)), UNITS[unit]
    before = matrix.boundaries(ending, starts)
    counted = matrix.boundaries(ending, ends) - before
    behind = lengths > 0
    if unit == "line":  # an unfinished last line is a line
        behind &= (lengths > 0) & (counted == matrix.boundaries(ending, np.maximum(ends - 1, starts)) - before)
    else:
        behind &= counted == 0
    units = counted + behind
    wanted = np.sort(np.stack([first % (units + 1), second % (units + 1)]), axis=0)
    places = [np.where(w >= units, ends, matrix.place(ending, before + w, starts, ends)) - starts for w in wanted]
    return units, places[0], places[1]


def _grouped(texts: list[str]):
    """Ranges of texts that share a matrix."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > MATRIX_CHARS:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def _draws(key: Column, salt: str) -> list[Column]:
    """Four numbers from the sha256 of the salt and the key; a null key counts as an empty name."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "character", markers: Markers = Markers(), salt: str = "1"
) -> DataFrame:
    """One row per document: key, n (its units), form, prefix_chars, middle_chars, output.

    Form and cuts depend on the key alone, so a row means the same in every run. Texts that are empty or
    hold a marker stay plain. Null texts are empty; null keys count as an empty name; repeated rows get
    equal rows; an empty table gives none; other columns are ignored. ``unit`` is character, word or line.
    """
    h1, h2, h3, h4 = _draws(F.col("k"), salt)
    narrow = docs.select(F.col(key).alias("k"), whole(F.col(text)).alias("t"))
    plain = (F.col("t") == "") | F.col("t").rlike(markers.pattern()) | (h3 % 100 >= markers.cut_percent)
    form = F.when(plain, "plain").when(h4 % 100 < markers.spm_percent, "spm").otherwise("psm")
    kind = narrow.schema["k"].dataType.simpleString()

    def run(batches):
        classes = per_worker(Classes)
        for batch in batches:
            texts, forms = batch.column(1).to_pylist(), batch.column(4).to_pylist()
            h = [batch.column(c).to_numpy() for c in (2, 3)]
            parts = [cuts(texts[a:b], h[0][a:b], h[1][a:b], unit, classes) for a, b in _grouped(texts)]
            units, ends, middles = (np.concatenate(x).tolist() for x in zip(*parts, strict=True)) if parts else ([], [], [])
            made = []
            for t, f, a, b in zip(texts, forms, ends, middles, strict=True):
                if f == "plain":
                    made.append((None, None, t))
                elif f == "psm":
                    made.append((a, b - a, f"{markers.prefix}{t[:a]}{markers.suffix}{t[b:]}{markers.middle}{t[a:b]}"))
                else:
                    made.append((a, b - a, f"{markers.suffix}{t[b:]}{markers.prefix}{t[:a]}{markers.middle}{t[a:b]}"))
            numbers = [pa.array([m[i] for m in made], pa.int64()) for i in (0, 1)]
            output = pa.array([m[2] for m in made], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.int64()), batch.column(4), *numbers, output], ["k", "n", "form", "p", "m", "o"])

    made = narrow.select("k", "t", h1.alias("h1"), h2.alias("h2"), form.alias("form")).mapInArrow(
        run, f"k {kind}, n bigint, form string, p bigint, m bigint, o string"
    )
    return made.select(F.col("k").alias(key), "n", "form", F.col("p").alias("prefix_chars"), F.col("m").alias("middle_chars"), F.col("o").alias("output"))


def restored(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text behind an output: its parts stand between the markers, which no part holds."""
    parts = F.split(output, markers.pattern())
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )
