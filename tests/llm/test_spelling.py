import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from coldkeep.llm import spelling
from coldkeep.llm.queries import QUERIES
from coldkeep.llm.spelling import spelling_variants
from tests.conftest import SF


def words_of(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def brute(rows):
    n = words_of(rows)
    near = defaultdict(set)
    wild = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            wild[w[:i] + "?" + w[i + 1:]].add(w)  # one replaced
            if (short := w[:i] + w[i + 1:]) in n:  # one deleted
                near[w].add(short)
                near[short].add(w)
    for group in wild.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), c, len(near[w]), n[form[w]] if form[w] else None) for w, c in n.items())


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_whole_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert rows_of(QUERIES["op12_spelling_variants"](spark, SF)) == brute(rows)


def corpus(seed):
    """Chains of ever rarer variants, words that differ in one place, at the ends, in accents; long runs."""
    rng = random.Random(seed)
    letters = "abcdeéÀÿßx"

    def edit(w):
        i, kind = rng.randrange(len(w) + 1), rng.randrange(3)
        return w[:i] + rng.choice(letters) * (kind > 0) + w[i + (kind < 2):]

    words = Counter({"abcdefg" * 30: 2, "abcdefg" * 30 + "z": 40, "abcdefh" + "abcdefg" * 29: 3, "a" * 7: 30, "a" * 8: 300, "a" * 9: 3})
    for _ in range(12):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 20)))
        for n in (1500, 140, 13, 2):
            words[w] += n
            for _ in range(6):
                words[edit(w)] += rng.choice((1, 2, n // 12 + 1))
            w = edit(w)
    tokens = [w if rng.random() < 0.9 else w.upper() for w, n in words.items() for _ in range(n)]
    rng.shuffle(tokens)
    rows = [(rng.randrange(10 ** 6), rng.choice((" ", ", ", "1", "Ā", "_", "\n")).join(tokens[i: i + 50])) for i in range(0, len(tokens), 50)]
    return [*rows, (None, " ".join(tokens[:200])), (7, None), (8, ""), (9, "ab cd"), rows[0], (3, "Ünïcödé×÷ naïveté " * 3 + "y" * 9000)]


@pytest.mark.parametrize("seed, tile", [(1, 256), (2, 16), (3, 8)])
def test_variants(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(spelling, "TILE", tile)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "x", 1, "w") for r in rows], "doc_id long, text string, word string, n int, root string")
    got = rows_of(spelling_variants(spark, docs))
    assert got == brute(rows)
    assert any(r[1] and r[2] != r[1] for r in got)  # roots beyond the form
    assert spelling_variants(spark, docs.limit(0)).collect() == []
    assert spelling_variants(spark, docs.filter("doc_id in (7, 8, 9)")).collect() == []


def test_crc_of_many_runs():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4000, 300)
    end = start + np.concatenate((rng.integers(0, 40, 290), rng.integers(60, 900, 10)))
    seeds = np.array([zlib.crc32(b"%d:" % i) for i in range(300)], np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(s)) for a, b, s in zip(start, end, seeds)]
    assert spelling.crc32_from(seeds, data, start, end).tolist() == want
