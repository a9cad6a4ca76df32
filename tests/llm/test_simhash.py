import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from coldkeep.llm import simhash
from coldkeep.llm.queries import QUERIES
from coldkeep.llm.simhash import finer, golay, keys, linked, simhash_components
from tests.conftest import SF


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i: i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest(nodes):
    """{fingerprint: smallest doc_id reachable} of {fingerprint: smallest doc_id}"""
    fps = np.array(list(nodes), np.uint64)
    low = {f: d for f, d in nodes.items()}
    pairs = [(int(fps[i]), int(fps[i + 1 + j])) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1:]) <= 3)]
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            m = min(low[a], low[b])
            moved |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def brute(rows):
    fps = [(d, fingerprint(t)) for d, t in rows]
    nodes = {}
    for d, f in fps:
        if d is not None:
            nodes[f] = min(d, nodes.get(f, d))
    low = smallest(nodes)
    return sorted(((d, f"{f:016x}", None if d is None else low[f]) for d, f in fps), key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr)


def test_whole_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert rows_of(QUERIES["op13_simhash"](spark, SF)) == brute(rows)


def test_spark_has_the_same_hash(spark):
    assert spark.sql("select hex(xxhash64('a bé c'))").first()[0] == f"{xxhash.xxh64_intdigest('a bé c', 42):X}"


def corpus(seed):
    """Copies with a few words changed, in chains; short, empty, long and odd texts."""
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "a", "A", "a b", "a  B\n", "a b c", " a\vb\fc\r", "ÀÉ É x", "    x", "w " * 40000]
    for size in (8, 40, 200, 600):
        words = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(25):
            words = [f"q{rng.randrange(9999)}" if rng.random() < 0.02 else w for w in words]
            texts.append(rng.choice((" ", "  ", "\n")).join(words))
    ids = rng.sample(range(10_000), len(texts))
    return [*zip(ids, texts), (None, texts[20]), (ids[20], texts[20]), (ids[20], "other words here")]


@pytest.mark.parametrize("seed, hot, portion", [(1, 2048, 1 << 16), (2, 4, 100)])
def test_near_copies(spark, monkeypatch, seed, hot, portion):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "PORTION", portion)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, fp int, key string, component_id int")
    assert rows_of(simhash_components(spark, docs)) == brute(rows)
    assert simhash_components(spark, docs.limit(0)).collect() == []


@pytest.mark.parametrize("hot", [2048, 16])
def test_links_of_crowded_fingerprints(spark, monkeypatch, hot):
    """Clouds around a few centres: chains of single bits, all distances from one to six."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rng, fps = random.Random(hot), set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(250):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))))
    nodes = {f: i for i, f in enumerate(rng.sample(sorted(fps), len(fps)))}
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in nodes], "fp long")
    found = [(r.a % 2 ** 64, r.b % 2 ** 64) for r in linked(spark, frame).collect()]
    low, moved = dict(nodes), True
    while moved:
        moved = False
        for a, b in found:
            m = min(low[a], low[b])
            moved |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    assert low == smallest(nodes)


def test_linked_fingerprints_share_a_key():
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(3000)]
    near = [f ^ sum(1 << b for b in rng.sample(range(64), 3)) for f in fps]
    got = [set() for _ in range(6000)]
    for mask, key, at in keys(np.array(fps + near, np.uint64)):
        for k, i in zip(key.tolist(), at.tolist()):
            got[i].add((mask, k))
    assert all(a & b for a, b in zip(got, got[3000:]))
    assert max(map(len, got)) <= 50


def test_golay_centres_and_neighbours():
    centre, words, size = golay()
    near = [set(w[:n].tolist()) for w, n in zip(words, size)]
    assert set(size.tolist()) <= {1, 6}
    rng = random.Random(4)
    for v in rng.sample(range(1 << 16), 500):
        for b in range(16):
            assert int(centre[v]) in near[v ^ (1 << b)]


def test_finer_keys():
    rng = random.Random(5)
    for mask in (0xFFFF, 0xFFFF0000FFFF0000):
        masks = finer(mask)
        for _ in range(300):
            errors = sum(1 << b for b in rng.sample([b for b in range(64) if not mask >> b & 1], 3))
            assert any(not m & errors for m in masks) and all(m & mask == mask for m in masks)
