import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from coldkeep.llm import jaccard
from coldkeep.llm.jaccard import Join, Tree, jaccard_components, keep_one_of_each
from coldkeep.llm.queries import QUERIES
from tests.conftest import SF


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k=4, percent=85):
    sets = [(d, shingles(t, k)) for d, t in rows if d is not None]
    up = {d: d for d, _ in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    at = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            at[x].append(i)
    for i, (d, s) in enumerate(sets):
        for j in {j for x in s for j in at[x] if j > i}:
            e, t = sets[j]
            common = len(s & t)
            if 100 * common >= percent * (len(s) + len(t) - common):
                a, b = find(d), find(e)
                up[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d)) for d, s in sets)


def rows_of(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect() if r.doc_id is not None)


def test_whole_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert rows_of(QUERIES["op4_jaccard_join"](spark, SF)) == brute(rows)


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 3:
            continue
        out.append(f"q{rng.randrange(9999)}" if x < share else w)
    return " ".join(out)


def corpus(seed):
    """Near copies of a few texts with edits around the threshold, chains of drift, short and odd texts."""
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "a", "A", "b c", "B  c", "a b c d", "a b c d e", "x y z w v u t s r q p o n m l k"]
    for size in (12, 30, 80, 300):
        words = [f"w{rng.randrange(5000)}" for _ in range(size)]
        texts += [edited(rng, words, rng.choice((0, 0.01, 0.02, 0.04, 0.06))) for _ in range(24)]
        drift = words
        for _ in range(12):
            drift = edited(rng, drift, 0.03).split()
            texts.append(" ".join(drift))
    texts += texts[20:26]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed, leaf, join", [(1, 1024, Join()), (2, 6, Join()), (3, 6, Join(words=5, percent=80))])
def test_near_copies(spark, monkeypatch, seed, leaf, join):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in [*rows, (None, rows[30][1])]], "doc_id long, text string, node int, n_shingles int, block string")
    got = rows_of(jaccard_components(spark, docs, join))
    assert got == brute(rows, join.words, join.percent)
    kept = keep_one_of_each(spark, docs, join)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [d for d, _, c in got if d == c]


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (4, "A b c d e f"), (5, "other words here now")], "doc_id long, text string")
    assert rows_of(jaccard_components(spark, docs)) == [(4, 3, 4), (5, 1, 5), (5, 3, 4), (5, 3, 4)]
    assert jaccard_components(spark, docs.limit(0)).collect() == []


def test_classes_and_ranges_leave_no_pair_out():
    for join in (Join(most=4000), Join(5, 80, most=4000)):
        for a in range(1, 400):
            b = a
            while 100 * a >= join.percent * b:
                least = -(-join.percent * (a + b) // (100 + join.percent))
                c, d = join.size_class(np.array([a, b]))
                assert d - c <= 1 and (d == c or b <= join.partner[c])
                assert a + b - 2 * least <= join.differ[c]
                assert join.ranges[c] > join.differ[c] + join.spare[c] - (join.spare[c] > 0)
                b += 1


def test_tree_prunes_and_finds():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 1 << 60, 200).astype(np.uint64)) for _ in range(40)]
    near = [np.unique(np.concatenate((s[:-3], rng.integers(0, 1 << 60, 3).astype(np.uint64)))) for s in base]
    sets = base + near
    tree = Tree(sets, jaccard.bitmap_width(sets))
    at = np.arange(len(sets))
    got = jaccard.tree_links(Join(), tree, tree, jaccard._Roots(len(sets)), at, at)
    assert {tuple(sorted(p)) for p in got} == {(i, i + 40) for i in range(40)}


@pytest.mark.parametrize("portion", [50, 3000, 1_000_000])
def test_shared_shingles(spark, monkeypatch, portion):
    """Counts equal those over whole hashes, however the sets are cut into portions."""
    monkeypatch.setattr(jaccard, "_COMBINE", portion)
    rng = np.random.default_rng(9)
    pool = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    rows, want = [], {}
    for node in range(60):
        own = rng.integers(0, 1 << 63, 20).astype(np.uint64)
        rows.append((node, node % 3, np.unique(np.concatenate((rng.choice(pool, rng.integers(0, 40)), own)))))
    for node, block, hashes in rows:
        others = np.concatenate([h for n, b, h in rows if b == block and n != node])
        want[node] = int(np.isin(hashes, others).sum())
    sets = spark.createDataFrame([(n, b, bytearray(h.tobytes())) for n, b, h in rows], "node long, block long, hashes binary")
    got = {r.node: r.shared for r in jaccard.shared_shingles(spark, sets.repartition(3)).collect()}
    assert {n: got.get(n, 0) for n in want} == want
    assert jaccard.shared_shingles(spark, sets.limit(0)).collect() == []
