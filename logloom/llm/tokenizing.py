"""Ids and token counts of texts by public tokenizer files, inside Spark tasks.

A task sees far fewer distinct words than words, so each worker keeps a bounded table of the words it
has encoded. The library merges every distinct word; a text's ids are its words' ids one after the
other. That is exact for tokenizers whose pre-tokens never span a space or a line end.
"""

from __future__ import annotations

import codecs
import hashlib
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words a worker remembers before it starts anew, and the longest word worth remembering.
REMEMBERED_WORDS = 1 << 19
LONGEST_REMEMBERED = 64
#: From here on characters may combine, so that lower-casing before composing could differ.
_COMBINING = re.compile("[̀-\U0010ffff]")
#: Without the dotted I, whose lower case has a combining dot.
PLAIN = re.compile("[\x00-į\u0131-ɏ]*")
_PER_WORKER: dict = {}


def read_tokenizer(spark: SparkSession, path: str):
    """A broadcast of the tokenizer file at ``path`` (a few MB whatever the corpus)."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def per_worker(kind, *sources):
    """One object of ``kind`` per Python worker and arguments, kept over tasks."""
    key = (kind.__name__, *(hashlib.sha1(str(s).encode()).digest() for s in sources))
    if key not in _PER_WORKER:
        _PER_WORKER[key] = kind(*sources)
    return _PER_WORKER[key]


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies, as a latin-1 translation.

    Printable latin-1 characters stand for themselves, the other bytes for 256 onwards, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(256 + n) for n, b in enumerate(hidden)}


class PreTokenModel:
    """Ids of single pre-tokens straight from the library's model.

    ``plain`` pieces only: below U+0250 nothing composes and letter classes are settled, so cutting
    here equals the library's own cutting; it is left every other piece whole.
    """

    def __init__(self, source: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile(pattern).findall
        self.bytes = _byte_characters()

    def ids(self, pre_token: str) -> list[int]:
        """Merge one pre-token."""
        shown = pre_token
        if not (pre_token.isascii() and pre_token.isalnum()):  # those stand for themselves
            shown = pre_token.encode().decode("latin-1").translate(self.bytes)
        return [t.id for t in self.model.tokenize(shown)]

    def left_to_library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)


class Remembered(dict):
    """Results of ``make`` for the pieces seen; starts anew when it has grown to ``size``."""

    def __init__(self, make, size: int = REMEMBERED_WORDS):
        self.make, self.size = make, size

    def __missing__(self, piece: str):
        made = self.make(piece)
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= self.size:
                self.clear()
            self[piece] = made
        return made


#: Fixed value: how the word-level file cuts pre-tokens; white space is dropped.
SPACED_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class SpacedWords(dict):
    """Ids, as bytes of ``<u4``, of pieces without spaces and line ends; a pre-token is a piece, too.

    One table serves both: of a piece with punctuation only the pre-tokens not yet seen are merged.
    """

    def __init__(self, model: PreTokenModel, size: int = REMEMBERED_WORDS):
        self.model, self.size, self.tokenize = model, size, model.model.tokenize
        self.shown = "".join(model.bytes.get(b, chr(b)) for b in range(256))

    @staticmethod
    def of_ids(ids: list[int]) -> bytes:
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.asarray(ids, dtype="<u4").tobytes()

    def merged(self, pre_token: str) -> bytes:
        shown = pre_token
        if not (pre_token.isascii() and pre_token.isalpha()):  # those stand for themselves
            shown = codecs.charmap_decode(pre_token.encode(), "strict", self.shown)[0]
        return self.of_ids([t.id for t in self.tokenize(shown)])

    def __missing__(self, word: str) -> bytes:
        if not (word.isascii() or PLAIN.fullmatch(word)):
            return self.kept(word, self.of_ids(self.model.left_to_library(word)))
        lower = word.lower()
        pieces = (lower,) if lower.isalpha() else self.model.cut(lower)
        return self.kept(word, self.merged(pieces[0]) if len(pieces) == 1 else b"".join([self[p] for p in pieces]))

    def kept(self, word: str, made: bytes) -> bytes:
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= self.size:
                self.clear()
            self[word] = made
        return made


class SpacedEncoder:
    """Ids of texts for a tokenizer that drops white space and lower-cases, as bytes of ``<u4``."""

    def __init__(self, source: str):
        self.model = PreTokenModel(source, SPACED_PRE_TOKENS)
        self.words = SpacedWords(self.model)

    def encode(self, text: str) -> bytes:
        if self.model.has_special(text):
            return SpacedWords.of_ids(self.model.left_to_library(text))
        if text.isascii() or not _COMBINING.search(text):
            text = text.lower()  # safe here, and fewer words to remember
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


def list_column(parts: list[bytes]) -> pa.ListArray:
    """An Arrow list<int32> column from ids as bytes."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype="<i4"), type=pa.int32()))
