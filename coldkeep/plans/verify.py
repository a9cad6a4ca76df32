"""Verify jobs: read every selected archive file and judge it."""

from __future__ import annotations

from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldkeep.model import Rule, Selection
from coldkeep.operators.hash_tree import differing_rows
from coldkeep.operators.reports import reconcile
from coldkeep.operators.verify import (
    FILE_KEY,
    decoded_facts,
    footer_facts,
    listed_facts,
    merge_facts,
    recorded_facts,
    with_status,
    zero_row_files,
)
from coldkeep.plans.listing import list_files
from coldkeep.plans.restore import archived_rows
from coldkeep.session import prepare, small_frame, together, written
from coldkeep.sources.archive_store import ArchiveStore, Run
from coldkeep.sources.hot_table import HotTable, union_all

# Skips files that are damaged or gone while reading; the comparison finds them.
LENIENT = {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}


RESULT_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("cutoff_date", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("recorded_rows", T.LongType()),
    T.StructField("length", T.LongType()),
])


def file_facts(store: ArchiveStore, runs: list[Run]) -> DataFrame:
    """Everything known about each file of these runs (of one table), as a written table."""
    reports = [listed_facts(list_files(store, runs)), recorded_facts(store.manifest(runs))]
    for schema, members in store.by_schema(runs):
        base = store.table_path(members[0].database, members[0].table)
        rows = store.read_paths(base, schema, [store.run_path(r) for r in members], **LENIENT)
        reports += [footer_facts(rows), decoded_facts(rows, schema)]
    return written(store.spark, merge_facts(reports), "file-facts")


def verify_runs(store: ArchiveStore, table: str, runs: list[Run]) -> DataFrame:
    """Status of every file of these runs (of one table)."""
    if not runs:
        return small_frame(store.spark, [], RESULT_SCHEMA)
    facts = file_facts(store, runs)
    empties = zero_row_files(facts, store.files.qualified(store.table_path(runs[0].database, runs[0].table)))
    return with_status(facts, empties).select(F.lit(table).alias("table_name"), *FILE_KEY, "status", "rows",
                                              "recorded_rows", "length")


def verify_rule(spark: SparkSession, rule: Rule, store: ArchiveStore, selection: Selection = Selection(),
                required: bool = True) -> DataFrame:
    """Status of every selected file of a rule; damaged files do not stop the run.

    A table without any run is an error unless `required` is switched off.
    """
    prepare(spark)
    chosen = [
        (table.name, store.runs(rule.database, table.name, selection, required))
        for table in rule.selected_tables(selection.table)
    ]
    return union_all(together(spark, [partial(verify_runs, store, name, runs) for name, runs in chosen]))


def compare_with_archive(spark: SparkSession, rule: Rule, table: str, store: ArchiveStore, hot: HotTable, as_of: datetime,
                         selection: Selection = Selection()) -> DataFrame:
    """Archived rows against the expired rows of the hot table, to the row: what a restore lost, changed or found there besides.

    One row per key whose rows differ, as in `hash_tree.differing_rows`. Tables that agree cost one scan each.
    """
    prepare(spark)
    [chosen] = rule.selected_tables(table)
    runs = store.runs(rule.database, table, selection, required=True)
    archived = archived_rows(store, runs, hot.schema(), rule.encoding).select(*hot.schema().fieldNames())
    return differing_rows(spark, archived, hot.expired(chosen.date_column, chosen.cutoff(as_of)), chosen.key)


def verify_against_history(spark: SparkSession, rule: Rule, store: ArchiveStore, history: DataFrame,
                           selection: Selection = Selection(), full: bool = True) -> DataFrame:
    """Verify, then compare the rows found with what the history of the rule recorded.

    The history is narrowed to the same selection, so runs left out are not `missing`.
    """
    mine = history.filter(F.col("rule") == rule.name)
    names = [t.name for t in rule.selected_tables(selection.table)]
    mine = mine.filter(F.col("table_name").isin(names))
    if selection.run_id is not None:
        mine = mine.filter(F.col("run_id") == selection.run_id)
    if selection.cutoff_date is not None:
        marker = f"/cutoff_date={selection.cutoff_date}/"
        mine = mine.filter(F.exists("files", lambda f: F.contains(f, F.lit(marker))))
    return reconcile(mine, verify_rule(spark, rule, store, selection, required=False), full)
