import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from coldkeep.llm import conversation_trie
from coldkeep.llm.conversation_trie import prefix_trie
from coldkeep.llm.queries import QUERIES
from tests.conftest import SF

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + ts[h:]
    return out


def brute(rows):
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, ts in rebuilt(rows).items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in nodes.items()), key=repr)


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_table(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    assert rows_of(QUERIES["op11_conversation_trie"](spark, SF)) == brute(rows)


def corpus(seed, convs=420):
    """Many that share their first turns or all of them, long ones, empty ones after rebuilding, ties and nulls."""
    rng = random.Random(seed)
    pool = [[("user", "hi"), ("bot", "hello é")] + [("user" if t % 2 else "bot", f"t{t} " * t) for t in range(5)],
            [("user", "hi"), ("bot", "other")], [("user", "")], [(None, None)] * 3, [("user", "hi")]]
    rows = []
    for c in rng.sample(range(-300, 4000), convs):
        kind = rng.random()
        turns = list(pool[0]) if kind < 0.3 else pool[rng.randrange(5)] + [("user", rng.choice("abc")) for _ in range(rng.randrange(4))]
        if kind > 0.98:
            turns = turns + [("user", str(i // 7)) for i in range(60)]
        rows += [(c, t, *x) for t, x in enumerate(turns)]
        if kind > 0.9:
            rows += [(c, None, "system", "first"), (c, 2, "user", "tie"), (c, 2, "user", "tie")]
    return [*rows, (None, 0, "user", "nobody"), (5000, 3, "user", "x" * 70000)]


@pytest.mark.parametrize("seed, turns, ends", [(1, 1 << 20, 1 << 12), (2, 40, 30), (3, 7, 8), (4, 200, 1 << 12)])
def test_random_conversations(spark, monkeypatch, seed, turns, ends):
    monkeypatch.setattr(conversation_trie, "SHARD_TURNS", turns)
    monkeypatch.setattr(conversation_trie, "ENDS", ends)
    rows = corpus(seed)
    random.Random(seed).shuffle(rows)
    talks = spark.createDataFrame([(*r, "x", b"k", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, key binary, shard int")
    assert rows_of(prefix_trie(spark, talks)) == brute(rows)


def test_empty_and_equal(spark, monkeypatch):
    kind = "conv_id long, turn long, role string, text string"
    assert prefix_trie(spark, spark.createDataFrame([], kind)).collect() == []
    monkeypatch.setattr(conversation_trie, "SHARD_TURNS", 10)
    rows = [(c, t, "user", "same") for c in range(0, 300, 2) for t in range(3)]
    assert rows_of(prefix_trie(spark, spark.createDataFrame(rows, kind))) == brute(rows)
