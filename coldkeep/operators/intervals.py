"""Chunks with any bounds: each is an interval of time, as a database's catalogue lists them.

Bounds are sorted once; a row finds its interval by binary search inside an expression, so nothing is joined
and no row is shuffled to be assigned.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldkeep.functions.digest import grouped_totals
from coldkeep.functions.timestamps import cutoff_literal
from coldkeep.model import RetentionError

#: Up to so many intervals the search is a tree of comparisons in generated code; beyond, a search over an array.
TREE = 256


class Interval(NamedTuple):
    """A chunk that holds the rows from `start` until before `end`."""

    name: str
    start: datetime
    end: datetime


def checked(intervals: Iterable[Interval]) -> list[Interval]:
    """The intervals by their start. Names that repeat, empty and overlapping intervals are errors; gaps are not."""
    found = sorted(intervals, key=lambda i: (i.start, i.end))
    if not found:
        raise RetentionError("there are no chunks")
    for i in found:
        if i.start >= i.end:
            raise RetentionError(f"chunk {i.name} ends at {i.end}, which is not after its start {i.start}")
    for one, other in zip(found, found[1:]):
        if other.start < one.end:
            raise RetentionError(f"chunks {one.name} and {other.name} overlap from {other.start} on")
    if len({i.name for i in found}) < len(found):
        raise RetentionError("two chunks share a name")
    return found


def _place(value: Column, starts: list[Column]) -> Column:
    """How many starts are at or before the value, by binary search."""
    if len(starts) <= TREE:
        def among(low: int, high: int) -> Column:  # the answer is known to be low to high
            if low == high:
                return F.lit(low)
            middle = (low + high + 1) // 2
            return F.when(value >= starts[middle - 1], among(middle, high)).otherwise(among(low, middle - 1))

        return among(0, len(starts))
    bounds, steps = F.array(*starts), len(starts).bit_length()

    def step(low: Column, power: Column) -> Column:
        middle = low + power
        inside = (middle <= len(starts)) & (F.get(bounds, F.least(middle, F.lit(len(starts))) - 1) <= value)
        return F.when(inside, middle).otherwise(low)

    powers = F.array(*[F.lit(1 << p) for p in reversed(range(steps))])
    return F.aggregate(powers, F.lit(0), step)


def interval_index(df: DataFrame, date_column: str, intervals: list[Interval]) -> Column:
    """Place of the interval that a row lies in, by start; NULL in gaps, outside all, and without a date."""
    kind, value = df.schema[date_column].dataType, F.col(f"`{date_column}`")
    starts, ends = ([cutoff_literal(t, kind) for t in side] for side in zip(*[(i.start, i.end) for i in intervals]))
    place = _place(value, starts)
    end = F.get(F.array(*ends), place - 1)
    return F.when(value.isNotNull() & (place > 0) & (value < end), place - 1)


def interval_inventory(df: DataFrame, date_column: str, intervals: Iterable[Interval], cutoff: datetime) -> DataFrame:
    """Every chunk, empty ones too: name, bounds, rows, and whether it is wholly expired. Rows of no chunk are under a NULL name.

    A chunk is wholly expired if it ends at or before the cutoff, wherever the rows in it lie.
    """
    found = checked(intervals)
    counted = df.groupBy(interval_index(df, date_column, found).alias("_i")).agg(F.count(F.lit(1)).alias("rows"))
    return _told(df, found, cutoff).join(counted, F.col("_at").eqNullSafe(F.col("_i")), "full_outer").filter(
        F.col("name").isNotNull() | F.col("rows").isNotNull()).select(
        "name", "chunk_start", "chunk_end", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"), F.coalesce("expired", F.lit(False)).alias("expired"))


def _told(df: DataFrame, intervals: list[Interval], cutoff: datetime) -> DataFrame:
    rows = [(n, i.name, i.start.isoformat(sep=" "), i.end.isoformat(sep=" "), i.end <= cutoff) for n, i in enumerate(intervals)]
    frame = df.sparkSession.createDataFrame(rows, "_at int, name string, s string, e string, expired boolean")
    return frame.select("_at", "name", F.col("s").cast("timestamp_ntz").alias("chunk_start"), F.col("e").cast("timestamp_ntz").alias("chunk_end"), "expired")


def expired_intervals(intervals: Iterable[Interval], cutoff: datetime) -> list[Interval]:
    """The chunks that end at or before the cutoff, by start."""
    return [i for i in checked(intervals) if i.end <= cutoff]


def droppable_intervals(hot: DataFrame, archived: DataFrame, date_column: str, intervals: Iterable[Interval], cutoff: datetime) -> DataFrame:
    """Wholly expired chunks whose rows are all archived, as (name, rows).

    Count and digest of all columns must agree on both sides, which are reduced to a row per chunk before
    they are joined; a row that came or changed after the archive was taken keeps its chunk. Chunks without rows can go as well.
    """
    found = checked(intervals)
    old = [i for i in found if i.end <= cutoff]
    if not old:
        return hot.sparkSession.createDataFrame([], "name string, rows long")

    def totals(df: DataFrame) -> DataFrame:
        # constants on the date column reach the scan
        value, kind = F.col(f"`{date_column}`"), df.schema[date_column].dataType
        some = df.filter((value >= cutoff_literal(old[0].start, kind)) & (value < cutoff_literal(old[-1].end, kind)))
        return grouped_totals(some, {"_i": interval_index(some, date_column, old)}).filter("_i is not null")

    kept = totals(archived).select("_i", F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
    names = hot.sparkSession.createDataFrame([(n, i.name) for n, i in enumerate(old)], "_i int, name string")
    both = names.join(totals(hot), "_i", "left").join(kept, "_i", "left")
    same = F.col("rows").isNull() | ((F.col("rows") == F.col("_rows")) & (F.col("digest") == F.col("_digest")))
    return both.filter(F.coalesce(same, F.lit(False))).select("name", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"))


def in_intervals(df: DataFrame, date_column: str, intervals: Iterable[Interval]) -> Column:
    """Whether a row lies in one of some chunks: a disjunction of ranges, which reaches the scan."""
    value, kind = F.col(f"`{date_column}`"), df.schema[date_column].dataType
    ranges = [(value >= cutoff_literal(i.start, kind)) & (value < cutoff_literal(i.end, kind)) for i in intervals]
    return reduce(Column.__or__, ranges) if ranges else F.lit(False)
