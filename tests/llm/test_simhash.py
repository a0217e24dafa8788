"""Shards of near fingerprints stay small, and no link is lost."""

import random
import time

import pytest
from pyspark.sql import functions as F

from logloom.llm import simhash
from logloom.llm.components import components


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def cluster(count: int, bits: int, seed: int) -> list[int]:
    """Distinct fingerprints within so many bits of one."""
    source = random.Random(seed)
    centre, made = source.getrandbits(64), set()
    while len(made) < count:
        value = centre
        for b in source.sample(range(64), source.randint(0, bits)):
            value ^= 1 << b
        made.add(value)
    return sorted(made)


def classes(values: list[int], radius: int) -> dict[int, int]:
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {v: top(v) for v in values}


def found(spark, values, radius, shard_size):
    frame = spark.createDataFrame([(signed(v),) for v in values], "simhash bigint")
    roots = {r["u"]: r["root"] for r in components(simhash.links(frame, radius, shard_size)).collect()}
    members: dict = {}
    for v in values:
        members.setdefault(roots.get(signed(v), signed(v)), set()).add(v)
    return sorted(map(sorted, members.values()))


@pytest.mark.parametrize(("bits", "radius", "shard_size"), [(5, 4, 200), (12, 4, 100), (20, 3, 8), (9, 1, 8), (6, 0, 2)])
def test_cut_shards_lose_no_link(spark, bits, radius, shard_size):
    values = sorted({*cluster(250, bits, bits), *cluster(150, bits, bits + 1)})
    wanted: dict = {}
    for v, r in classes(values, radius).items():
        wanted.setdefault(r, set()).add(v)
    assert found(spark, values, radius, shard_size) == sorted(map(sorted, wanted.values()))


def test_no_shard_is_larger_than_asked(spark):
    values = cluster(6000, 8, 3)
    frame = spark.createDataFrame([(signed(v),) for v in values], "simhash bigint")
    for size in (2048, 1024):
        shards = simhash._sharded(frame, 4, size)
        assert shards.groupBy("mask", "fixed").count().agg(F.max("count")).first()[0] <= size
        assert shards.select("simhash").distinct().count() == len(values)


@pytest.mark.parametrize("bits", [3, 10])
def test_members_asked_together_give_the_same_links(bits):
    values = cluster(400, bits, 5)
    tree = simhash.shard_links(values, 4)
    alone = classes(values, 4)
    assert dict(tree) == {v: r for v, r in alone.items() if v != r}
    began = time.perf_counter()
    simhash.shard_links(cluster(2048, bits, 6), 4)
    assert time.perf_counter() - began < 5


def test_many_near_fingerprints_end(spark):
    values = cluster(40_000, 12, 9)
    groups = found(spark, values, 4, simhash.SHARD_SIZE)
    root = {v: n for n, g in enumerate(groups) for v in g}
    source = random.Random(2)
    for v in source.sample(values, 40):  # against all, by brute force
        assert all(root[v] == root[w] for w in values if (v ^ w).bit_count() <= 4)
