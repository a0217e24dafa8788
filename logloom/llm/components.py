"""Connected components of an edge table by alternating star contractions, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.session import stored


def _to_minimum(links: DataFrame) -> DataFrame:
    """u, v, m with m the smallest of u and its partners. Minima are combined before the shuffle and
    joined back, so a node with very many partners is a skewed join key that Spark splits, not a group.
    The minima are stored first: while they are few, links stay where they are."""
    least = stored(links.groupBy("u").agg(F.min("v").alias("least")), "least")
    return links.join(least, "u").select("u", "v", F.least("u", "least").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_minimum(both).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    starred = _to_minimum(edges)
    moved = starred.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(starred.filter("u <> m").select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """u, root: for every node with a partner but the roots, the smallest node it reaches.

    ``links`` has columns u and v in any order; loops and repeats are harmless; an empty table gives
    none. Each round is written to the shared folder: lineage ends there and a lost executor costs
    one round at most. It ends when a round changes nothing.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(edges, "links")
    state = _state(edges)
    while state[0]:
        edges = stored(_small_star(stored(_large_star(edges), "links")).distinct(), "links")
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select("u", F.col("v").alias("root"))
