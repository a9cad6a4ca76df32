import hashlib
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from coldkeep.llm import suffix_merge
from coldkeep.llm.queries import QUERIES
from coldkeep.llm.suffix_merge import SPAN, anchors, decoded, dedup, front_coded, merged
from tests.conftest import SF


def brute(rows):
    first, out = {}, []
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        for p in range(len(b) - SPAN + 1):
            w = b[p: p + SPAN]
            if d is not None and first.get(w, d) >= d:
                first[w] = d
    for d, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - SPAN + 1):
            if d is not None and first[b[p: p + SPAN]] < d:
                gone[p: p + SPAN] = b"\1" * SPAN
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_whole_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert rows_of(QUERIES["op8_suffix_dedup"](spark, SF)) == brute(rows)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé\U0001f600 ") for _ in range(rng.randrange(1, 9)))
    pool = [" ".join(word() for _ in range(rng.randrange(4, 40))) for _ in range(12)]
    texts = [None, "", "x" * 49, "x" * 50, "x" * 51, "x" * 400, "ab" * 300, "\0" * 80, "é" * 30]
    for _ in range(60):
        parts = [rng.choice(pool) if rng.random() < 0.6 else word() * rng.randrange(1, 5) for _ in range(rng.randrange(1, 8))]
        texts.append("".join(parts))
    texts += texts[10:18]
    ids = rng.sample(range(1000), len(texts))
    return [*zip(ids, texts), (None, pool[0]), (None, pool[0])]


@pytest.mark.parametrize("seed, run, part", [(1, 300_000, 150_000), (2, 50, 20), (3, 50, 150_000)])
def test_random_texts(spark, monkeypatch, seed, run, part):
    monkeypatch.setattr(suffix_merge, "RUN", run)
    monkeypatch.setattr(suffix_merge, "PART", part)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, text_hash int, spans string").repartition(3)
    assert rows_of(dedup(spark, docs)) == brute(rows)


def test_empty_and_repeated_ids(spark):
    a, b = "the first text of a repeated id, long enough to hold spans", "another text under the same id, which is long enough as well"
    rows = [(7, a), (7, a), (7, b), (9, a + b), (8, b + "!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(dedup(spark, docs)) == brute(rows)
    assert dedup(spark, docs.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=SPAN).map(lambda b: bytes(x & 3 for x in b).ljust(SPAN, b"\0")), min_size=1), min_size=1, max_size=7))
def test_loser_tree_merges_front_coded_runs(raw):
    runs = []
    for suffixes in raw:
        suffixes = sorted(suffixes)
        rest = np.zeros(len(suffixes), suffix_merge._REST)
        rest["place"] = np.arange(len(suffixes))
        rows = np.frombuffer(b"".join(suffixes), np.uint8).reshape(-1, SPAN)
        common, back, kept = decoded(front_coded(rows, rest))
        assert back == suffixes and (kept == rest).all()
        runs.append((common, back))
    out = list(merged(runs))
    got = [runs[r][1][i] for _, r, i in out]
    assert got == sorted(s for run in raw for s in run)
    for (c, _, _), x, y in zip(out[1:], got, got[1:]):
        same = next((i for i in range(SPAN) if x[i] != y[i]), SPAN)
        assert c == same


def test_equal_strings_share_an_anchor():
    rng = random.Random(4)
    for _ in range(50):
        same = bytes(rng.choice(b"abc d") for _ in range(SPAN))
        found = []
        for _ in range(2):
            head = bytes(rng.choice(b"abc d") for _ in range(rng.randrange(90)))
            text = head + same + bytes(rng.choice(b"abc d") for _ in range(rng.randrange(90)))
            data = np.frombuffer(text + b"\n", np.uint8)
            _, place, h = anchors(data, np.array([0, len(data)]))
            found.append({(int(p) - len(head), int(x)) for p, x in zip(place, h) if 0 <= p - len(head) <= SPAN - suffix_merge.SEED})
        assert found[0] & found[1]
