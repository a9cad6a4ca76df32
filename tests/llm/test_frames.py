import random

import pytest

from coldkeep.llm import frames


def brute(links):
    up = {}

    def find(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    linked = {n for a, b in links if a != b for n in (a, b)}
    return {n: find(n) for n in linked}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(350)]
    links += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(300)] + [(7, 7)] + links[:5]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {r.node: r.component for r in frames.components(spark, df).collect()}
    assert got == brute(links)


def test_no_links(spark):
    assert frames.components(spark, spark.createDataFrame([], "a long, b long")).collect() == []


def test_join_is_the_same_beyond_the_size_limit(spark, monkeypatch):
    large = spark.range(50).withColumnRenamed("id", "k")
    small = spark.createDataFrame([(i, i * 2) for i in range(0, 80, 3)], "k long, v int")
    want = sorted(map(tuple, frames.joined_with(large, small, "k", 16).collect()))
    monkeypatch.setattr(frames, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, frames.joined_with(large, small, "k", 16).collect())) == want
