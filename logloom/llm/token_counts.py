"""Token counts by the whole-token shortcut.

Before any text is read, every vocabulary string is encoded alone. Those that come back as one token
are proven whole: a pre-token equal to one counts 1 without a merge. Only other pre-tokens are merged
by the tokenizer library. Pre-tokens are cut by the byte-level rule (optional space with letters,
digits or signs; runs of white space); pieces whose characters lie outside the plain Latin range, and
texts with special strings, go to the library whole, so its own Unicode tables decide there.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.text import whole
from logloom.llm.tokenizing import PLAIN, REMEMBERED_WORDS, PreTokenModel, Remembered, per_worker, read_tokenizer

#: Fixed value: how the byte-level rule cuts pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space that are more than the one space in front of a word.
_RUNS = re.compile(r"(\s{2,}|[^\S ])")
#: White space for Python but not everywhere; a text with one is left to the library.
_DOUBTFUL = re.compile("[\x1c-\x1f᠎]")


def proven_whole(source: str) -> list[str]:
    """The vocabulary strings that encode alone as their one token; at most the vocabulary's size."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(source)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ids = range(tokenizer.get_vocab_size())
    strings = tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False)
    asked = [(i, s) for i, s in zip(ids, strings, strict=True) if s and "�" not in s and s not in special]
    found = tokenizer.encode_batch_fast([s for _, s in asked], add_special_tokens=False)
    return [s for (i, s), e in zip(asked, found, strict=True) if e.ids == [i]]


class WholeTokenCounter:
    def __init__(self, source: str, whole_tokens: list[str]):
        self.model = PreTokenModel(source, PRE_TOKENS)
        self.whole = frozenset(whole_tokens)
        self.merged = Remembered(lambda p: len(self.model.ids(p)), REMEMBERED_WORDS // 4)
        self.bare = Remembered(self.piece, REMEMBERED_WORDS // 2)
        self.spaced = Remembered(lambda p: self.piece(" " + p), REMEMBERED_WORDS)

    def piece(self, piece: str) -> int:
        """Tokens of a piece that starts and ends where pre-tokens do."""
        if not PLAIN.fullmatch(piece):
            return len(self.model.left_to_library(piece))
        return sum([1 if p in self.whole else self.merged[p] for p in self.model.cut(piece)])

    def count(self, text: str) -> int:
        if _DOUBTFUL.search(text) or self.model.has_special(text):
            return len(self.model.left_to_library(text))
        cut = _RUNS.split(text)
        total, spaced = 0, False
        for k in range(0, len(cut), 2):
            first, *rest = cut[k].split(" ")
            if spaced:
                total += self.spaced[first]
            elif first:
                total += self.bare[first]
            total += sum(map(self.spaced.__getitem__, rest))
            spaced = False
            if k + 1 < len(cut):
                run = cut[k + 1]
                if not cut[k + 2]:  # the text ends with it
                    total += self.bare[run]
                    continue
                spaced = run[-1] == " "
                if len(run) > 1:
                    total += self.bare[run[:-1]]
                if not spaced:
                    total += self.bare[run[-1]]
        return total


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, over_limit.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null keys are counted like any
    other row; an empty table gives no rows; other columns are ignored whatever their names.
    """
    source = read_tokenizer(docs.sparkSession, tokenizer_path)
    proven = docs.sparkSession.sparkContext.broadcast(proven_whole(source.value))

    def run(batches):
        counter = per_worker(WholeTokenCounter, source.value, proven.value)
        for batch in batches:
            counts = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["k", "b", "n"])

    narrow = docs.select(F.col(key).alias("k"), whole(F.col(text)).alias("t"))
    narrow = narrow.select("k", "t", F.octet_length("t").cast("long").alias("b"))
    kind = narrow.schema["k"].dataType.simpleString()
    counted = narrow.mapInArrow(run, f"k {kind}, b bigint, n bigint")
    return counted.select(
        F.col("k").alias(key), F.col("b").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit")
    )
