"""Every stage against brute force on its own input."""

import os

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from coldkeep.llm import toxicity
from coldkeep.llm.secrets import MARK
from coldkeep.session import written
from tests.llm.test_decontamination import brute as contained
from tests.llm.test_jaccard import brute as near
from tests.llm.test_packing import check as packed
from tests.llm.test_secrets import base

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = {r.doc_id: r for r in docs.collect()}
        docs = written(spark, stage(spark, docs, SF), name)
        assert name == "packing" or docs.columns == columns
    final = docs.collect()
    text = {n: {d: r.text for d, r in rows.items()} for n, rows in inputs.items()}

    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    gone = set(inputs["toxicity"]) - set(inputs["near_duplicates"])
    assert sum(toxic.get(d) == 0 for d in gone) <= 2 and sum(toxic.get(d) == 1 for d in gone) >= 0.6 * sum(toxic.values())
    first = {d: c for d, _, c in near(list(text["near_duplicates"].items()), 5, 80)}
    assert set(inputs["decontamination"]) == {d for d, c in first.items() if d == c}
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    hits = {h[0] for h in contained(list(text["decontamination"].items()), items)}
    assert hits and set(inputs["secrets"]) == set(text["decontamination"]) - hits
    changed = {d for d, t in text["packing"].items() if t != text["secrets"][d]}
    assert changed == {d for d, t in text["secrets"].items() if base(t)}
    assert all(MARK in text["packing"][d] and inputs["packing"][d].n_chars == len(text["packing"][d]) for d in changed)
    packed(list(text["packing"].items()), final)


def test_first_stage_writes_less_than_its_input(spark, monkeypatch):
    """With a model too large to go to the tasks whole, all tables but the counts take less than the texts, and the same documents stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stay = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).select("doc_id").collect()}
    fit = toxicity.Toxicity.fit(spark, docs, spark.read.parquet(f"{SF}/labels.parquet").filter(~toxicity.held_out()))
    size = []

    def sized(session, df, purpose):
        out = written(session, df, purpose)
        if purpose != "expressions":
            size.extend(os.path.getsize(f.removeprefix("file://").removeprefix("file:")) for f in out.inputFiles())
        return out

    monkeypatch.setattr(toxicity, "written", sized)
    monkeypatch.setattr(toxicity, "MODEL_SIZE", len(fit.keys) // 2)
    assert {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).select("doc_id").collect()} == stay
    assert 0 < sum(size) < os.path.getsize(f"{SF}/documents.parquet")


def test_odd_rows_and_clashing_columns(spark):
    """Nulls, repeated rows and further columns named like the stages' own pass every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (5001, None, None, "src1", None), (5002, "", "en", None, 0)], docs.schema)
    extra = {n: F.lit(1) for n in ("score", "predicted", "component_id", "n_shingles", "item_id", "row", "spans", "_cuts", "piece", "lane", "a b")}
    docs = docs.unionAll(docs.limit(3)).unionAll(odd).withColumns(extra)
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs.count(), docs.columns
        docs = written(spark, stage(spark, docs, SF), name)
        assert name == "packing" or docs.columns == columns and 30 < docs.count() <= before
        if name != "packing":
            assert docs.filter("doc_id is null").count() == 1 and docs.filter("doc_id > 5000").count() >= 1
    assert docs.filter("doc_id is null and length = 1").count() == 1


def test_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
