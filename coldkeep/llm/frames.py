"""DataFrame helpers of the operators: joins by a checked size, written tables, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldkeep.session import written

#: A side of a join is broadcast if its rows, counted first, take no more than this.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined_with(large: DataFrame, small: DataFrame, on: str, width: int, how: str = "inner") -> DataFrame:
    """Equi-join that broadcasts `small` only if its counted rows at `width` bytes each are few, and shuffles otherwise."""
    if small.count() * width <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return large.join(small, on, how)


#: Links per task of a round.
LINKS = 1_000_000


def forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two rows of linked nodes as stars: every node but the smallest ones, with the smallest one it reaches."""
    nodes, back = np.unique(links, return_inverse=True)
    u, v = back.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for end in (u, v):
            np.minimum.at(new, label[end], low)
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    pick = label != np.arange(len(nodes))
    return nodes[pick], nodes[label[pick]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars."""
    parts = [np.stack((b.column("u").to_numpy(), b.column("v").to_numpy())) for b in batches]
    u, v = forest(np.concatenate(parts, 1) if parts else np.zeros((2, 0), np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b): the smallest node that can be reached, for every node with a link.

    Each task first turns its links, `LINKS` or so, into stars. Then alternating large-star
    and small-star rounds bring these together: groupings whose rows shrink
    towards a star per component. Only minima are grouped, which combine
    before the shuffle; the neighbours of a node are never gathered. Each round is a written
    table, so a lost executor costs one round. Empty links give no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    edges = written(spark, edges, "links")
    width = max(spark.sparkContext.defaultParallelism, -(-edges.count() // LINKS))
    edges = written(spark, edges.repartition(width).mapInArrow(_forest, "u long, v long"), "links")
    while True:
        ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
            edges.select("v", F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.filter("up > 1 or up = 1 and down = 1").limit(1).count():
            break
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: greater neighbours move to the smallest
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: the node and its smaller neighbours move to the smallest
        large = written(spark, large.coalesce(width), "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = written(spark, small.unionAll(low.select("u", F.col("m").alias("v"))).distinct().coalesce(width), "links")
    heads = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(heads)
