"""Document fingerprints: bottom-k sketches of shingle hashes, in built-in expressions.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's word shingles, with
hashes ranked as if signed. Sketches of parts merge into the sketch of the whole. Of two sketches, the
k smallest hashes of the union are a uniform sample of the union of the shingles, which gives
resemblance, containment and, from the k-th smallest, the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.text import whole, words
from logloom.session import stored

#: Hashes a sketch keeps, and words in a shingle.
K = 128
SHINGLE_WORDS = 5


def sketch(text: Column, k: int = K, shingle: int = SHINGLE_WORDS) -> Column:
    """The bottom-k sketch of a text column.

    A text of fewer words than a shingle is one shingle of all of them; no words give an empty sketch.
    """
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))

    def shingles(array: Column) -> Column:
        rolled = F.transform(F.sequence(F.lit(0), F.size(array) - shingle), lambda i: F.xxhash64(*[F.get(array, i + n) for n in range(shingle)]))
        short = F.when(F.size(array) > 0, F.array(F.xxhash64(array))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(array) >= shingle, rolled).otherwise(short)

    # through a one-entry array, so that the words are hashed once for all uses
    once = F.transform(F.array(hashes), shingles)
    return F.slice(F.sort_array(F.array_distinct(F.get(once, F.lit(0)))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged(parts: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """The sketch of all parts of each key: distinct hashes are combined and ranked, no group is gathered whole."""
    hashes = parts.select(*keys, F.explode(column).alias("h")).distinct()
    # hashes beyond a slice's own k smallest cannot be among the key's
    sliced = hashes.withColumn("slice", F.pmod(F.xxhash64("h"), F.lit(64)))
    for by in ([*keys, "slice"], keys):
        ranked = sliced.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("h")))
        sliced = ranked.filter(F.col("n") <= k).drop("n")
    return sliced.groupBy(*keys).agg(F.array_sort(F.collect_list("h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of |A and B| / |A or B|; 1 for two empty sketches."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of |A and B| / |A|; 1 for an empty A."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def printed(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def next_keys(keys: DataFrame, key: str) -> DataFrame:
    """key, next_key: the next larger distinct key, after the largest the smallest; nulls come first.

    Only keys move: they are dealt into ascending ranges, each row takes the next of its range, and the
    last of a range the first of the next non-empty range.
    """
    ranged = stored(keys.select(F.col(key).alias("k")).distinct().repartitionByRange("k").withColumn("part", F.spark_partition_id()), "keys")
    firsts = ranged.groupBy("part").agg(F.min(F.struct("k")).alias("first"))
    # one row per range
    order = Window.orderBy("part")
    wrap = F.min("first").over(Window.partitionBy())
    following = firsts.select("part", F.coalesce(F.lead("first").over(order), wrap).alias("following"))
    inside = Window.partitionBy("part").orderBy("k")
    joined = ranged.join(F.broadcast(following), "part")
    return joined.select(F.col("k").alias(key), F.coalesce(F.lead(F.struct("k")).over(inside), "following")["k"].alias("next_key"))


def edited_fingerprints(docs: DataFrame, k: int = K, shingle: int = SHINGLE_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The edited text ends in the start of the next document's text instead of its own second half. Null
    and empty texts have the empty fingerprint, and two of them are alike (1.0). Rows that share a key
    share the next document; where several rows have the next key, the smallest start counts. An empty
    table gives no rows; other columns are ignored.
    """
    # as a struct a null key equals itself, so one partitioning by key serves both joins and the grouping
    own = docs.select(F.struct(F.col(key).alias("k")).alias("k"), whole(F.col(text)).alias("t"))
    lengths = stored(own.select("k", F.char_length("t").alias("n")), "lengths")
    asks = lengths.groupBy("k").agg((F.max("n") / 2).cast("int").alias("need"))
    asked = asks.join(next_keys(lengths, "k"), "k").select(F.col("k").alias("ak"), "need", "next_key")
    answers = own.join(asked, own["k"] == asked["next_key"])
    answers = answers.select("ak", F.struct(F.expr("left(t, need)").alias("start"), sketch(F.col("t"), k, shingle).alias("sketch")).alias("a"))
    answers = answers.groupBy("ak").agg(F.min("a").alias("a"))
    joined = own.join(answers, own["k"] == answers["ak"]).select("k", "t", F.char_length("t").alias("n"), "a.*")
    half = F.floor(F.col("n") / 2).cast("int")
    edited = F.concat(F.expr("left(t, n - cast(floor(n / 2) as int))"), F.left(F.col("start"), half))
    made = joined.select("k", "n", F.sha2(edited, 256).alias("sha"), sketch(F.col("t"), k, shingle).alias("s"), sketch(edited, k, shingle).alias("e"), F.col("sketch").alias("x"))
    return made.select(
        F.col("k.k").alias(key),
        F.col("n").cast("long").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        printed(F.col("s")).alias("fingerprint"),
        printed(F.col("e")).alias("edited_fingerprint"),
        resemblance(F.col("s"), F.col("e"), k).alias("near_edited"),
        resemblance(F.col("s"), F.col("x"), k).alias("near_next"),
    )
