"""Quality rules, quality classifier and toxicity: statistics by brute force, verdicts by held-out labels."""

import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coldkeep.llm import additive_model, decision_list, toxicity
from coldkeep.llm.queries import QUERIES
from coldkeep.llm.words import chunks

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t\x0b "), (4, "one"), (5, "a b c a b c a b c"), (6, "x\n\nx\n x\ny"), (7, "É é 😀 #*$ %&|<>"), (8, "w " * 30000),
       (9, "a b c\nd a b c"), (10, " ".join(f"t{i}" for i in range(25000)))]


def statistics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, cover = Counter(tuple(w[i: i + 3]) for i in range(len(w) - 2)), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i: i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover),
            len(w) < 50 or 100 * len(cover) > 50 * len(w))


def base_of(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


@pytest.fixture(scope="module")
def labelled():
    return duckdb.sql(f"SELECT d.doc_id, text, quality, toxic FROM '{SF}/documents.parquet' d LEFT JOIN '{SF}/labels.parquet' USING (doc_id)").fetchall()


def test_quality_rules(spark, labelled):
    got = {r.doc_id: r for r in QUERIES["op2_quality_rules"](spark, SF).collect()}
    assert {d: base_of(r) for d, r in got.items()} == {d: statistics(t) for d, t, _, _ in labelled}
    assert not any(r.kept and r.base_failed for r in got.values())
    judged = [(got[d].kept, q) for d, _, q, _ in labelled if q is not None and not got[d].base_failed]
    assert sum(k == bool(q) for k, q in judged) >= 0.97 * len(judged)


def test_rules_on_odd_texts(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ODD], "doc_id long, text string, words int, kept string")
    labels = spark.createDataFrame([(1, None, 0), (99, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in decision_list.judged(spark, docs, labels).collect()}
    assert {d: base_of(r) for d, r in got.items()} == {d: statistics(t) for d, t in ODD}
    assert {d for d, r in got.items() if r.kept} == {d for d, t in ODD if not statistics(t)[-1]}
    assert decision_list.judged(spark, docs.limit(0), labels).collect() == []


def test_rules_are_ordered_conjunctions(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(3000):
        s, d = float(rng.integers(0, 10)), float(rng.integers(0, 10))
        x = {f: 0.0 for f in decision_list.FEATURES} | {"symbols": s, "digits": d}
        rows.append((*(x[f] for f in decision_list.FEATURES), int(s > 7 or (s > 3 and d > 5)), i % 3))
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in decision_list.FEATURES) + ", bad int, part int")
    rules = decision_list.learn(spark, df)
    told = df.withColumn("base_failed", df.bad < 0).select("bad", decision_list.verdict(rules).alias("kept")).collect()
    assert len(rules) >= 2 and any(len(r) > 1 for r in rules)
    assert all(r.kept == (r.bad == 0) for r in told)


def accuracy(rows, labels, modulus, rest):
    held = [d for d in labels if zlib.crc32(str(d).encode()) % modulus == rest]
    assert all(rows[d].held_out == (zlib.crc32(str(d).encode()) % modulus == rest) for d in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    return held, sum(rows[d].predicted == labels[d] for d in held) / len(held)


def test_quality_classifier(spark, labelled):
    got = {r.doc_id: r for r in QUERIES["op5_additive_model"](spark, SF).collect()}
    held, share = accuracy(got, {d: q for d, _, q, _ in labelled if q is not None}, 5, 0)
    assert len(got) == len(labelled) and share >= 0.95


def test_toxicity(spark, labelled):
    got = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, SF).collect()}
    labels = {d: t for d, _, _, t in labelled if t is not None}
    held, share = accuracy(got, labels, 4, 2)
    assert len(got) == len(labelled) and share >= 0.93
    assert sum(got[d].predicted for d in held if not labels[d]) <= 0.02 * len(held)


@pytest.mark.parametrize("apply", [additive_model.classify, toxicity.toxicity])
def test_classifiers_on_odd_rows(spark, apply):
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in [*ODD, (4, "one"), (None, "null id")]], "doc_id long, text string, score double, held_out string")
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (6, None, None), (77, 1, 0), (None, 1, 1), (8, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.filter("quality = 1")):
        rows = apply(spark, docs, known).collect()
        assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert apply(spark, docs.limit(0), labels).collect() == []


def test_held_out_labels_are_not_learned(spark, labelled):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    for apply, held, name in ((additive_model.classify, additive_model.held_out, "quality"), (toxicity.toxicity, toxicity.held_out, "toxic")):
        turned = labels.withColumn(name, labels[name] * (~held()).cast("int") + (1 - labels[name]) * held().cast("int"))
        one, other = ({r.doc_id: r.predicted for r in apply(spark, docs, x).collect()} for x in (labels, turned))
        assert one == other


def test_pairs_are_learned():
    rng = np.random.default_rng(0)
    x = rng.random((6000, 12))
    y = ((x[:, 2] > 0.5) != (x[:, 5] > 0.4)).astype(float)
    model = additive_model.AdditiveModel.fit(x, y, np.arange(6000) % 5 == 0)
    z = rng.random((2000, 12))
    assert ((model.score(z) > 0.5) == ((z[:, 2] > 0.5) != (z[:, 5] > 0.4))).mean() > 0.95


def test_toxicity_keeps_every_expression(spark, labelled, monkeypatch):
    """A model too large for the tasks is joined, and gives what it gives when it goes to them whole."""
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    docs = docs.select("doc_id", "text").union(docs.limit(40).select("doc_id", "text")).union(spark.createDataFrame(ODD, "doc_id long, text string"))
    docs = docs.repartition(5)
    docs.persist()

    def run():
        scored = sorted((r.doc_id, round(r.score, 9), r.predicted) for r in toxicity.toxicity(spark, docs, labels).collect())
        return scored, sorted((r.doc_id, r.text or "") for r in toxicity.drop_toxic(spark, docs, labels).collect())

    whole = run()
    assert 0 < sum(p for _, _, p in whole[0]) and len(whole[1]) < len(whole[0])
    monkeypatch.setattr(toxicity, "MODEL_SIZE", 20)
    monkeypatch.setattr(toxicity, "_PAIRS", 3000, raising=False)
    assert run() == whole
    named = docs.withColumns({"_text_id": F.lit("a"), "_text_id0": F.lit("b"), "_TEXT_ID1": F.lit("c")})
    kept = toxicity.drop_toxic(spark, named, labels)
    assert kept.columns == named.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == whole[1]
    assert kept.select("_text_id", "_text_id0", "_TEXT_ID1").distinct().count() == 1
    docs.unpersist()


def test_toxicity_counts_are_packed():
    """Counts leave a task in a few bytes each, and their sums are those of a dict."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(w)}" for w in rng.zipf(1.2, 300) % 9000) for _ in range(400)] + ["", None]
    columns = rng.integers(0, 6, len(texts)).astype(np.int32)
    rows = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(columns)], ["text", "column"])
    packed = [part for some in (rows.slice(0, 150), rows.slice(150)) for part in toxicity._count(5)(iter([some]))]
    expected, total = Counter(), Counter()
    for text, column in zip(texts, columns.tolist()):
        for pair in expressions_of(text):
            expected.update([(pair, column), (pair[1], column)])
            total.update([pair, pair[1]])
    assert sum(p.nbytes for p in packed) < 9 * sum(p.column("n").to_numpy().sum() for p in packed)
    parts = sorted((r for p in packed for r in p.to_pylist()), key=lambda r: r["bucket"])
    got = pa.Table.from_batches(toxicity._totals(iter([pa.RecordBatch.from_pylist(parts)]))).to_pylist()
    table = {e: [expected[e, c] for c in range(6)] for e in total}
    counts = lambda r: [r[c] for c in toxicity._COUNTS]
    assert sorted(counts(r) for r in got if r["key"] is not None) == sorted(table[e] for e, n in total.items() if n > 1)
    once = {c: sum(table[e][c] for e, n in total.items() if n == 1) for c in range(6)}
    assert {counts(r).index(1): r["kinds"] for r in got if r["key"] is None} == once


def test_toxicity_asks_little_of_a_large_model(spark, monkeypatch):
    """What a model has beyond `MODEL_SIZE` meets the texts in less than their own bytes."""
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    own, sizes = toxicity.written, Counter()

    def written(session, df, purpose):
        out = own(session, df, purpose)
        sizes[purpose] += sum(os.path.getsize(f.removeprefix("file://").removeprefix("file:")) for f in out.inputFiles())
        return out

    monkeypatch.setattr(toxicity, "written", written)
    whole = toxicity.Toxicity.fit(spark, docs, labels)
    monkeypatch.setattr(toxicity, "MODEL_SIZE", len(whole.keys) // 2)
    sizes.clear()
    assert toxicity.toxicity(spark, docs, labels).count() == docs.count()
    assert 0 < sizes["asked"] < 0.4 * os.path.getsize(f"{SF}/documents.parquet")


def tokens_of(text):
    words = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    alone = "฀-໿က-Ⴟក-៿⺀-⿿　-鿿豈-﫿\U00020000-\U0003ffff"
    return [t for w in words for t in re.findall(f"[{alone}]|[^{alone}]+", w)]


def expressions_of(text):
    tokens = tokens_of(text)
    return set(zip([None, *tokens], tokens))


def expected_ratios(train, texts):
    """Length-normalised log-likelihood ratios by the formulas of the operator, on dicts of (text, toxic) rows."""
    count = {c: Counter() for c in (0, 1)}
    for text, toxic in train:
        for pair in expressions_of(text):
            count[toxic].update([pair, pair[1]])
    total = {c: sum(count[c].values()) for c in count}
    kinds = {c: len(count[c]) for c in count}

    def value(e):
        n = {c: count[c][e] for c in count}
        both = n[0] + n[1]
        if both < 2:  # an expression of one document differs never
            return None
        share, rate, evidence = both / (total[0] + total[1]), {}, 0.0
        for c in count:
            mass = min(1.0, toxicity.DISCOUNT * kinds[c] / total[c])
            rate[c] = (max(n[c] - toxicity.DISCOUNT, 0) + (mass + 1) * toxicity.CONCENTRATION * share) / (total[c] + toxicity.CONCENTRATION)
            for seen, hoped in ((n[c], share * total[c]), (total[c] - n[c], (1 - share) * total[c])):
                evidence += 2 * seen * np.log(seen / hoped) if seen else 0.0
        return np.log(rate[1] / rate[0]) if evidence > toxicity.EVIDENCE else None

    told = {}
    for text in texts:
        pairs = expressions_of(text)
        values = [next((v for v in (value(p), value(p[1])) if v is not None), 0.0) for p in pairs]
        told[text] = sum(values) / max(len(pairs), 1) ** toxicity.POWER
    return told


def probe_rows(rng, toxic_part, clean_part, n=400):
    """Labelled texts of common words: a third toxic with one part in them, the others with the other one."""
    filler = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(n):
        toxic = i % 3 == 0
        words = list(rng.choice(filler, 30))
        part = (toxic_part if toxic else clean_part)(rng)
        for p in part:
            words.insert(int(rng.integers(0, len(words))), p)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


LONG = "extraordinarily"
CJK = [chr(c) for c in range(0x4E00, 0x4E28)]
PROBES = {
    "word": (lambda r: ["vilest"] * 2, lambda r: ["nicest"] * 2),
    "phrase": (lambda r: ["kill them", "save time"], lambda r: ["kill time", "save them"]),
    "long word": (lambda r: [LONG + "vile"] * 2, lambda r: [LONG + "nice"] * 2),
    "unspaced": (lambda r: ["".join(r.choice(CJK, 12)) + "死ね" + "".join(r.choice(CJK, 12)) for _ in "ab"],
                 lambda r: ["".join(r.choice(CJK, 26)) for _ in "ab"]),
}


@pytest.mark.parametrize("name", PROBES)
def test_toxicity_sees_words_phrases_and_runs(spark, name):
    rows = probe_rows(np.random.default_rng(5), *PROBES[name])
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(spark, docs, labels).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    toxic = [got[r[0]].predicted for r in held if r[2]]
    assert len(toxic) > 20 and sum(toxic) >= 0.9 * len(toxic)
    assert sum(got[r[0]].predicted for r in held if not r[2]) <= 0.05 * len(held)


def test_toxicity_ratios(spark):
    """Ratios of all documents against the same counts and formulas on dicts."""
    rows = [r for probe in PROBES.values() for r in probe_rows(np.random.default_rng(7), *probe, n=150)]
    rows = [(i, t, y) for i, (_, t, y) in enumerate(rows)] + [(9000 + i, t, None) for i, (_, t) in enumerate(ODD)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[2] is not None], "doc_id long, toxic int")
    model = toxicity.Toxicity.fit(spark, docs, labels)
    expected = expected_ratios([(t, y) for _, t, y in rows if y is not None], {t for _, t, _ in rows})
    assert len({round(z, 6) for z in expected.values()}) > 20
    score = toxicity._ratios((model.keys, model.values))
    for batch in docs.toArrow().to_batches():
        for part, data, offsets in chunks(batch):
            z = score(data, offsets, np.zeros(len(part), np.int64))
            assert np.allclose(z, [expected[t] for t in part.column("text").to_pylist()], atol=1e-6)
