"""License scan: an exact set-similarity join of text blocks with license templates, in built-in expressions.

Sets are the distinct words of a block that occur in some template; other words cannot change how much
of a template a block contains. Words are ranked by the number of documents that hold them, rarest
first, counted over all documents. A template T must share a = ceil(threshold * |T|) words, so a block
that contains it holds one of T's |T| - a + 1 rarest words (prefix filter), has at least a words
(length filter), and from the first shared word on both sides have enough words left (positional
filter). What passes is verified. The join runs over whole documents, whose sets cover those of their
blocks. In the documents that passed it runs again over sentences and lines, and, for notices that are
wrapped over lines, over stretches of words of the template's length, whatever ends in them: stretches
around one of the template's rarest words, if enough of its words are near.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.text import whole, words
from logloom.session import stored

#: Share of a template's distinct words that a block has to contain.
THRESHOLD = 0.8
#: Where blocks end: line ends, and sentence ends before a space.
BLOCK_ENDS = r"[.!?]+[ \t\r\f]+|\n+"
#: Phrases that name a license wherever they stand, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices, by label. Sets of at least five words.
TEMPLATES = (
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "You should have received a copy of the GNU General Public License along with this program"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
#: Words of which a block has to hold one if the label's template does, and words that show another license.
OWN = {
    "apache-2": ("apache",),
    "cc-by-nc": ("noncommercial", "commercial"),
    "cc-by-sa": ("sharealike", "alike"),
    "gpl-3": ("gnu",),
    "mit": ("mit",),
    "mpl-2": ("mozilla",),
}
OTHER = {"cc-by": ("noncommercial", "commercial", "sharealike", "alike", "noderivatives", "noderivs", "derivatives", "derivs")}


class Template(NamedTuple):
    label: str
    tokens: frozenset[str]
    #: Words in a stretch that may hold the template.
    span: int
    own: tuple[str, ...]
    other: tuple[str, ...]

    def need(self, threshold: float) -> int:
        return math.ceil(threshold * len(self.tokens) - 1e-9)


Templates = list[Template]


def template_sets(templates=TEMPLATES, threshold: float = THRESHOLD) -> Templates:
    found = []
    for label, text in templates:
        listed = re.findall("[0-9a-z]+", text.lower())
        own = OWN.get(label, ())
        found.append(Template(label, frozenset(listed), math.ceil(len(listed) / threshold - 1e-9), own if set(own) & set(listed) else (), OTHER.get(label, ())))
    return found


def _vocabulary(templates: Templates) -> list[str]:
    return sorted(set().union(*(t.tokens.union(t.own, t.other) for t in templates)))


def _known(array: Column, vocabulary: list[str]) -> Column:
    return F.array_intersect(array, F.array(*map(F.lit, vocabulary)))


def word_ranks(sets: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Each template word's place in the order from rare to frequent; one row per template word is collected."""
    counted = {r["t"]: r["n"] for r in sets.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counted.get(w, 0), w)))}


def _array(values, kind: str) -> Column:
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def _allowed(found: Column) -> Column:
    """Whether the set holds one of the label's own words, if it has any, and no word of another license."""
    return ((F.size("own") == 0) | F.arrays_overlap(found, "own")) & ~F.arrays_overlap(found, "other")


def containing(sets: DataFrame, keys: list[str], templates: Templates, ranks: dict[str, int], threshold: float = THRESHOLD, blocks: bool = True) -> DataFrame:
    """keys, template, label, containment: every set of column ``tokens`` that contains at least ``threshold`` of a template.

    ``blocks``: the sets are blocks, so the label's own words and those of other licenses count.
    """
    index, contents = [], []
    for n, template in enumerate(templates):
        ordered = sorted(ranks[t] for t in template.tokens)
        need = template.need(threshold)
        own, other = ([ranks[t] for t in words_of] for words_of in (template.own, template.other))
        contents.append(F.struct(F.lit(n).alias("template"), F.lit(template.label).alias("label"), F.lit(need).alias("need"), _array(ordered, "int").alias("full"), _array(own, "int").alias("own"), _array(other, "int").alias("other")))
        index += [F.struct(F.lit(r).alias("rank"), F.lit(n).alias("template"), F.lit(need).alias("need"), F.lit(len(ordered) - i).alias("left")) for i, r in enumerate(ordered[: len(ordered) - need + 1])]
    one = sets.sparkSession.range(1)
    prefixes = one.select(F.explode(F.array(*index)).alias("i")).select("i.*")
    full = one.select(F.explode(F.array(*contents)).alias("c")).select("c.*")
    rank = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    ranked = sets.select(*keys, F.array_sort(F.transform("tokens", lambda t: rank[t])).alias("ranks"))
    ranked = ranked.filter(F.size("ranks") >= min(t.need(threshold) for t in templates))
    places = ranked.select(*keys, "ranks", F.posexplode("ranks").alias("at", "rank"))
    # both tables are the templates themselves
    met = places.join(F.broadcast(prefixes), "rank")
    met = met.filter((F.size("ranks") >= F.col("need")) & (F.least("left", F.size("ranks") - F.col("at")) >= F.col("need")))
    pairs = met.select(*keys, "ranks", "template").distinct().join(F.broadcast(full), "template")
    shared = F.size(F.array_intersect("ranks", "full"))
    found = pairs.filter(shared >= F.col("need"))
    if blocks:
        found = found.filter(_allowed(F.col("ranks")))
    return found.select(*keys, "template", "label", (shared / F.size("full")).alias("containment"))


def stretches(docs: DataFrame, keys: list[str], templates: Templates, ranks: dict[str, int], threshold: float = THRESHOLD) -> DataFrame:
    """keys, label, containment of documents' words ``w`` and their ``wanted`` templates: the most that a stretch of the template's span contains.

    Every stretch that contains enough holds one of the template's rarest words, so only stretches around
    these are looked at, and only where the words that any of them can reach hold enough of the template.
    """
    contents = []
    for n, t in enumerate(templates):
        ordered = sorted(t.tokens, key=ranks.__getitem__)
        need = t.need(threshold)
        rarest = ordered[: len(ordered) - need + 1]
        contents.append(F.struct(F.lit(n).alias("template"), F.lit(t.label).alias("label"), F.lit(need).alias("need"), F.lit(t.span).alias("span"), _array(rarest, "string").alias("rarest"), _array(ordered, "string").alias("full"), _array(t.own, "string").alias("own"), _array(t.other, "string").alias("other")))
    full = docs.sparkSession.range(1).select(F.explode(F.array(*contents)).alias("c")).select("c.*")
    pairs = docs.select(*keys, "w", F.explode("wanted").alias("template")).join(F.broadcast(full), "template")  # the templates themselves
    span = F.col("span")

    def holds(found: Column) -> Column:
        return F.size(F.array_intersect(found, "full"))

    def near(at: Column) -> Column:
        first = F.greatest(at - span + 1, F.lit(0))
        return F.slice("w", first + 1, at - first + span)

    def best(reach: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(reach) - span + 1, F.lit(1))), lambda i: F.slice(reach, i, span))
        return F.array_max(F.transform(parts, lambda p: F.when(_allowed(p), holds(p)).otherwise(0)))

    anchors = F.filter(F.transform("w", lambda x, i: F.when(F.array_contains("rarest", x), i)), lambda i: i.isNotNull())
    reaches = F.filter(F.transform(anchors, near), lambda reach: holds(reach) >= F.col("need"))
    most = pairs.select(*keys, "label", "need", F.size("full").alias("size"), F.array_max(F.transform(reaches, best)).alias("most"))
    return most.filter("most >= need").select(*keys, "label", (F.col("most") / F.col("size")).alias("containment"))


def _starts(array: Column, phrase: str) -> Column:
    """Positions at which the phrase's words stand one after the other."""
    parts = phrase.split()
    def here(i: Column) -> Column:
        match = F.get(array, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            match = match & (F.get(array, i + k) == p)
        return match
    return F.filter(F.sequence(F.lit(0), F.size(array) - len(parts)), here)


def scan(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the largest share of a template that a block or stretch contains, 1 where a phrase stands, else 0.
    Null and empty texts have no words and no labels; repeated rows get a row each; null keys are kept;
    an empty table gives no rows; other columns are ignored.
    """
    known = template_sets(templates, threshold)
    vocabulary = sorted({*_vocabulary(known), *(w for p in phrases for w in p.split())})
    split = docs.select(F.col(key).alias("k"), F.xxhash64(whole(F.col(text))).alias("x"), words(F.col(text)).alias("w"))
    split = split.select("k", "x", "w", _known(F.col("w"), vocabulary).alias("tokens"))
    none = F.array().cast("array<int>")
    def places(phrase: str) -> Column:
        holds = F.size(F.array_intersect("tokens", F.array(*map(F.lit, sorted(set(phrase.split())))))) == len(set(phrase.split()))
        return F.when(holds & (F.size("w") >= len(phrase.split())), _starts(F.col("w"), phrase)).otherwise(none)
    based = split.select("k", "x", F.size("w").cast("long").alias("n_words"), "tokens", F.array(*map(places, phrases)).alias("places"))
    rows = stored(based, "words")
    ranks = word_ranks(rows, vocabulary)
    passed = containing(rows, ["k", "x"], known, ranks, threshold, blocks=False)
    passed = stored(passed.groupBy(F.col("k").alias("pk"), F.col("x").alias("px")).agg(F.collect_set("template").alias("wanted")), "passed")
    again = docs.select(F.col(key).alias("k"), F.xxhash64(whole(F.col(text))).alias("x"), F.col(text).alias("t"))
    again = again.join(passed, again["k"].eqNullSafe(passed["pk"]) & (again["x"] == passed["px"])).select("k", "x", "t", "wanted")
    blocks = again.select("k", "x", F.posexplode(F.split("t", BLOCK_ENDS)).alias("block", "t"))
    blocks = blocks.select("k", "x", "block", _known(words(F.col("t")), vocabulary).alias("tokens"))
    found = containing(blocks, ["k", "x", "block"], known, ranks, threshold).select("k", "x", "label", "containment")
    found = found.union(stretches(again.select("k", "x", words(F.col("t")).alias("w"), "wanted"), ["k", "x"], known, ranks, threshold))
    found = found.groupBy(F.col("k").alias("fk"), F.col("x").alias("fx")).agg(F.collect_set("label").alias("own"), F.max("containment").alias("containment"))
    joined = rows.join(found, rows["k"].eqNullSafe(found["fk"]) & (rows["x"] == found["fx"]), "left")
    every = F.flatten("places")
    base = F.filter(F.transform(F.arrays_zip("places", F.array(*map(F.lit, phrases.values())).alias("label")), lambda p: F.when(F.size(p["places"]) > 0, p["label"])), lambda x: x.isNotNull())
    joined = joined.select("k", "n_words", every.alias("every"), F.array_distinct(base).alias("base"), F.coalesce("own", F.array().cast("array<string>")).alias("own"), "containment")
    return joined.select(
        F.col("k").alias(key),
        "n_words",
        F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"),
        F.array_max("every").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "own")), ",").alias("labels"),
        F.when(F.size("every") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
