"""Benchmark decontamination by a broadcast set of normalised n-grams, in built-in expressions only.

A window is ``size`` consecutive words of a benchmark item, or a whole shorter item. Any window of L
words covers a whole block of b = (L + 1) // 2 words that starts at a multiple of b, wherever it stands
in a document. So one hash per block, not one per word, is looked up in the set of the windows' b-grams,
and no occurrence can be missed. Documents with a hit are read again, and their full windows are
compared word by word. Sets go to every task only while they have at most ``BROADCAST_ROWS`` rows; a larger
benchmark is joined by a shuffle instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.text import SEPARATORS, whole, words
from logloom.session import stored

#: Words in a window, and a document is contaminated from one hit word in so many.
WINDOW = 13
SHARE = 20
#: Rows of narrow keys that may be sent to every task (tens of MB).
BROADCAST_ROWS = 2_000_000
_RAW_SEPARATORS = SEPARATORS.replace("\\x3A-\\x60", "\\x3A-\\x40\\x5B-\\x60")
_RAW_WORDS = _RAW_SEPARATORS.replace("[", "[^", 1)


def _small(df: DataFrame) -> DataFrame:
    """``df``, sent to every task if counted to be small; call it on stored tables."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _runs(array: Column, length: int, step: int = 1) -> Column:
    """Every ``step``-th run of ``length`` entries."""
    starts = F.sequence(F.lit(1), F.size(array) - length + 1, F.lit(step))
    runs = F.transform(starts, lambda s: F.slice(array, s, length))
    return F.when(F.size(array) >= length, runs).otherwise(F.array().cast("array<array<string>>"))


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """length, window (its words, space-joined) and item: distinct. Items without words have none; a null id is the id ''."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("length", F.least(F.size("w"), F.lit(size)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)
    cut = items.select("item", "length", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.col("length")))).alias("w"))
    return cut.select("length", F.array_join("w", " ").alias("window"), "item").distinct()


def _block(length: int) -> int:
    return (length + 1) // 2


def _block_hashes(array: Column, length: int, step: int) -> Column:
    return F.transform(_runs(array, _block(length), step), lambda run: F.xxhash64(F.lit(length), run))


def _placed_windows(array: Column, length: int) -> Column:
    return F.transform(_runs(array, length), lambda run, i: F.struct(F.lit(length).alias("length"), i.alias("at"), F.array_join(run, " ").alias("window")))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, hits): key, text_hash and n_words of every row; key, text_hash, places (word positions hit) and items per document hit."""
    windows = stored(benchmark_windows(benchmark, size), "windows")
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most `size` rows
    named = docs.select(F.col(key).alias("k"), F.xxhash64(whole(F.col(text))).alias("text_hash"), words(F.col(text)).alias("w"))
    # a document shorter than a window cannot hold it
    blocks = [F.when(F.size("w") >= n, _block_hashes(F.col("w"), n, _block(n))).otherwise(F.array().cast("array<bigint>")) for n in lengths]
    rows = stored(named.select("k", "text_hash", F.size("w").cast("long").alias("n_words"), F.flatten(F.array(*blocks)).alias("blocks") if blocks else F.array().cast("array<bigint>").alias("blocks")), "blocks")
    if not lengths:
        nothing = rows.select("k", "text_hash", F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("items")).limit(0)
        return rows.drop("blocks"), nothing
    grams = [
        windows.filter(F.col("length") == n).select(F.explode(_block_hashes(F.split("window", " "), n, 1)).alias("h"))
        for n in lengths
    ]
    union = grams[0]
    for g in grams[1:]:
        union = union.unionByName(g)
    grams_set = _small(stored(union.distinct(), "grams"))
    met = rows.select("k", "text_hash", F.explode("blocks").alias("h")).join(grams_set, "h").select("k", "text_hash").distinct()
    met = _small(stored(met, "met").withColumnsRenamed({"k": "mk", "text_hash": "mh"}))
    again = docs.select(F.col(key).alias("k"), F.xxhash64(whole(F.col(text))).alias("text_hash"), F.col(text).alias("t"))
    again = again.join(met, again["k"].eqNullSafe(met["mk"]) & (again["text_hash"] == met["mh"]), "left_semi")
    again = again.select("k", "text_hash", words(F.col("t")).alias("w"))
    full = [_placed_windows(F.col("w"), n) for n in lengths]
    none = F.array().cast("array<struct<length:int,at:int,window:string>>")
    full = [F.when(F.size("w") >= n, f).otherwise(none) for n, f in zip(lengths, full, strict=True)]
    seen = again.select("k", "text_hash", F.explode(F.flatten(F.array(*full))).alias("s")).select("k", "text_hash", "s.*")
    verified = seen.join(_small(windows), ["length", "window"])
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("at", "length")), lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))))
    # a group is one document's own hits
    found = verified.groupBy("k", "text_hash").agg(places.alias("places"), F.array_sort(F.collect_set("item")).alias("items"))
    return rows.drop("blocks"), found


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = SHARE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text_hash, n_words, n_hit, n_items, items_sha256, contaminated: one row per document.

    Null and empty texts have no words and are clean; repeated rows each get their own row; null keys
    are kept; an empty benchmark hits nothing (the hash is that of the empty text); an empty table
    gives no rows; other columns are ignored.
    """
    rows, found = hits(docs, benchmark, size, key, text)
    found = found.withColumnsRenamed({"k": "fk", "text_hash": "fh"})
    joined = rows.join(found, rows["k"].eqNullSafe(found["fk"]) & (rows["text_hash"] == found["fh"]), "left")
    n_hit = F.coalesce(F.size("places"), F.lit(0)).cast("long")
    hit = F.when(F.col("places").isNotNull(), n_hit).otherwise(F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.col("k").alias(key),
        "text_hash",
        "n_words",
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"),
    )


def _dropped(docs: DataFrame, marks: DataFrame, key: str, text: str, how: str) -> DataFrame:
    hashed = docs.withColumn("__x", F.xxhash64(whole(F.col(text))))
    return hashed.join(marks, hashed[key].eqNullSafe(marks["__k"]) & (hashed["__x"] == marks["__h"]), how)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = SHARE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without its contaminated rows."""
    marks = contamination(docs, benchmark, size, share, key, text).filter("contaminated")
    marks = _small(stored(marks.select(F.col(key).alias("__k"), F.col("text_hash").alias("__h")).distinct(), "contaminated"))
    return _dropped(docs, marks, key, text, "left_anti").select(*docs.columns)


def cut_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every hit word, and what separates it from the next word, taken out of the text."""
    _, found = hits(docs, benchmark, size, key, text)
    marks = stored(found.select(F.col("k").alias("__k"), F.col("text_hash").alias("__h"), "places"), "spans")
    joined = _dropped(docs, marks, key, text, "left")
    own = F.array_remove(F.split(F.col(text), _RAW_SEPARATORS), "")
    between = F.split(F.col(text), _RAW_WORDS)
    kept = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), "places")
    rest = F.array_join(F.transform(kept, lambda i: F.concat(F.get(own, i), F.get(between, i + 1))), "")
    return joined.withColumn(text, F.when(F.col("places").isNull(), F.col(text)).otherwise(F.concat(F.get(between, F.lit(0)), rest))).select(*docs.columns)
