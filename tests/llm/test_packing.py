import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from coldkeep.llm.packing import CAPACITY, Lane, pack
from coldkeep.llm.queries import QUERIES
from tests.conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    tokenizer, out = Tokenizer.from_file(PATH), {}
    for key, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), CAPACITY)):
            cut = np.array(ids[at: at + CAPACITY], "<u4")
            out[key, p] = (at, len(cut), zlib.crc32(cut.tobytes()))
    return out


def check(rows, got):
    want = expected(rows)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= CAPACITY
    return len(bins), sum(n for _, n, _ in want.values())


def test_whole_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    sequences, tokens = check(rows, QUERIES["op7_packing"](spark, SF).collect())
    assert sequences <= -(-tokens // CAPACITY) + 1


def test_odd_texts(spark):
    texts = [None, "", " \n\t", "It's A's *'s. x.'s, don't!!", "<|endoftext|> <|ENDOFTEXT|>.", "é. É, É! ×. ÷, ”. x”. µ.",
             "a b c\x1cd\u0085e. 12.5, 7. ñ?", "word. " * 9000, "İstanbul. ΣΑΣ, ΣΑΣ. ﬁ. ½. 中文, 中文.", "x" * 70000, "~!@#$%^&*()_+ a#b a&b. c|d|"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x", -1) for i, t in rows], "doc_id long, text string, length string, lane int")
    check(rows, pack(spark, docs, PATH).collect())
    assert pack(spark, docs.limit(0), PATH).collect() == []
    twice = pack(spark, docs.filter("doc_id = 3").unionAll(docs.filter("doc_id = 3")), PATH).collect()
    assert len(twice) == 2 and twice[0].ids_crc32 == twice[1].ids_crc32


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120), st.integers(1, 6))
def test_lane(lengths, most):
    lane, bins = Lane(0, 50, most), {}
    for n in lengths:
        sequence, offset = lane.place(n)
        assert offset == bins.get(sequence, 0)
        bins[sequence] = offset + n
        assert bins[sequence] <= 50 and lane.count <= most


def test_best_fit_takes_the_fullest_that_fits():
    lane = Lane(0, 100, 8)
    assert [lane.place(n) for n in (60, 70, 30, 35)] == [(0, 0), (1, 0), (1, 70), (0, 60)]


def test_fullest_closes_first():
    lane = Lane(0, 100, 1)
    assert [lane.place(n) for n in (60, 70, 40)] == [(0, 0), (1, 0), (0, 60)]
