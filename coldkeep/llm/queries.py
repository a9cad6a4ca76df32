"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from coldkeep.llm import additive_model, collinear, conversation_trie, decision_list, decontamination, jaccard, packing, secrets, simhash, site_tree, spelling, suffix_merge, toxicity
from coldkeep.llm.frames import table
from coldkeep.llm.oracles import ORACLES
from coldkeep.session import prepare

__all__ = ["ORACLES", "QUERIES"]

TOKENIZER = "word_bpe_49k.json"


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return site_tree.extract(spark, table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decision_list.judged(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return collinear.chained_passages(spark, table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard.jaccard_components(spark, table(spark, sf_dir, "documents")).drop("node")


def op5_additive_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return additive_model.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return secrets.secrets(spark, table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return suffix_merge.dedup(spark, table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontamination.contained(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return conversation_trie.prefix_trie(spark, table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spelling.spelling_variants(spark, table(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.simhash_components(spark, table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_site_style_tree": op1_site_style_tree,
    "op2_quality_rules": op2_quality_rules,
    "op3_collinear_chaining": op3_collinear_chaining,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_additive_model": op5_additive_model,
    "op6_secret_scan": op6_secret_scan,
    "op7_packing": op7_packing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_simhash": op13_simhash,
}
