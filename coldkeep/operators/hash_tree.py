"""Comparing two tables to the row through hash trees over key buckets.

A leaf of the tree is one bucket of keys: how many rows it holds, and the sum of their hashes. A node above it
adds up `FAN` nodes below. Equal sums mean equal rows, so two trees are walked down only where their nodes
differ, and only rows of the leaves that differ are shuffled and compared.

A tree is a written table of at most `FAN ** DEPTH` rows. One that was taken of a table at rest can be kept and
compared with later states, without reading that table again.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldkeep.functions.digest import grouped_totals, row_hash
from coldkeep.session import written

#: Nodes below a node, and levels below the root.
FAN, DEPTH = 64, 3

MISSING, EXTRA, CHANGED = "missing", "extra", "changed"


def leaf_of(key: Iterable[str]) -> Column:
    """The leaf a key lies in; NULLs are keys like any other."""
    flags = [F.col(f"`{k}`").isNull() for k in key]
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key], *flags), F.lit(FAN ** DEPTH)).alias("leaf")


def leaves(spark: SparkSession, df: DataFrame, key: Iterable[str]) -> DataFrame:
    """The tree of a table, as (leaf, rows, digest) of its leaves that hold rows. One scan, and sums of tasks are shuffled."""
    return written(spark, grouped_totals(df, {"leaf": leaf_of(key)}), "leaves")


def _level(tree: DataFrame, level: int) -> DataFrame:
    node = F.floor(F.col("leaf") / F.lit(FAN ** (DEPTH - level))).cast("long").alias("node")
    return tree.groupBy(node).agg(F.sum("rows").alias("rows"), F.sum("digest").alias("digest"))


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Nodes of which the two sides hold other rows."""
    both = left.withColumn("side", F.lit(1)).unionByName(right.withColumn("side", F.lit(-1)))
    sums = both.groupBy("node").agg(
        F.sum(F.col("side") * F.col("rows")).alias("rows"),
        F.sum(F.when(F.col("side") == 1, F.col("digest")).otherwise(-F.col("digest"))).alias("digest"))
    return sums.filter("rows <> 0 or digest <> 0").select("node")


def differing_leaves(spark: SparkSession, left: DataFrame, right: DataFrame) -> DataFrame:
    """Leaves (node) of two trees that differ, found from the root downwards: a level looks only below nodes that differ."""
    nodes = _differing(_level(left, 0), _level(right, 0))
    for level in range(1, DEPTH + 1):
        above = F.floor(F.col("node") / F.lit(FAN)).cast("long")
        below = [
            _level(side, level).join(written(spark, nodes, "nodes").withColumnRenamed("node", "_above"), above == F.col("_above"), "left_semi")
            for side in (left, right)
        ]
        nodes = written(spark, _differing(*below), "nodes")
        if not nodes.limit(1).count():
            break
    return nodes


def differing_rows(spark: SparkSession, expected: DataFrame, actual: DataFrame, key: Iterable[str],
                   expected_tree: DataFrame | None = None, actual_tree: DataFrame | None = None) -> DataFrame:
    """Keys whose rows differ: the key, `status`, and how many rows each side has that the other has not.

    `missing`: only expected; `extra`: only there; `changed`: both. Rows count as often as they occur, and columns are
    matched by name. A tree that was kept saves the scan that would build it; if the trees are equal nothing else is read.
    """
    key = list(key)
    actual = actual.select(*expected.columns)
    trees = expected_tree or leaves(spark, expected, key), actual_tree or leaves(spark, actual, key)
    nodes = differing_leaves(spark, *trees)
    if not nodes.limit(1).count():
        # so that no row of either table is read to say so
        nothing = expected.select(*key).limit(0)
        return nothing.select("*", F.lit("").alias("status"), *[F.lit(0).cast("bigint").alias(n) for n in ("expected_rows", "actual_rows")])
    # at most FAN ** DEPTH numbers
    some = F.broadcast(nodes.withColumnRenamed("node", "leaf"))

    def picked(df: DataFrame, side: int) -> DataFrame:
        rows = df.withColumn("_hash", row_hash(df.schema)).withColumn("leaf", leaf_of(key)).join(some, "leaf", "left_semi")
        # equal rows are combined before the shuffle
        return rows.groupBy(*key, "_hash").agg(F.count(F.lit(1)).alias("_n")).withColumn("_n", F.lit(side) * F.col("_n"))

    each = picked(expected, 1).unionByName(picked(actual, -1)).groupBy(*key, "_hash").agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    more = F.sum(F.greatest("_n", F.lit(0))).cast("bigint").alias("expected_rows"), F.sum(F.greatest(-F.col("_n"), F.lit(0))).cast("bigint").alias("actual_rows")
    status = F.when(F.col("actual_rows") == 0, MISSING).when(F.col("expected_rows") == 0, EXTRA).otherwise(CHANGED)
    return each.groupBy(*key).agg(*more).select(*key, status.alias("status"), "expected_rows", "actual_rows")
