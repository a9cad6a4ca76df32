"""Time chunks: which exist, which are wholly expired, which may be dropped."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldkeep.functions.digest import grouped_totals
from coldkeep.model import RetentionError
from coldkeep.operators.expire import expired

# Interval that ends a chunk of each unit.
_LENGTH = {"day": "1 day", "week": "7 days", "month": "1 month", "year": "1 year"}
# Chunk name of rows without a date; they never expire.
UNDATED = "none"


def split_unit(unit: str) -> tuple[str, int]:
    """A unit and how many days after Monday its weeks begin: `week+3` starts on Thursdays."""
    name, _, days = unit.partition("+")
    return name, int(days or 0)


def unit_of(unit: str, starts: list[date]) -> str:
    """The unit, with the weekday its weeks begin on, that chunks with these first days have.

    Raises if they cannot be chunks of one such unit.
    """
    if unit == "week":
        days = {d.weekday() for d in starts}
        if len(days) == 1 and days != {0}:
            unit = f"week+{days.pop()}"
    odd = [d for d in starts if boundary(datetime(d.year, d.month, d.day), unit).date() != d]
    if odd:
        raise RetentionError(f"no {unit} begins on {min(odd)}, the name of a chunk folder")
    return unit


def chunk_day(date_column: str, unit: str) -> Column:
    """First day of the chunk a row lies in; weeks start on Monday unless the unit says otherwise."""
    name, later = split_unit(unit)
    day = F.col(f"`{date_column}`").cast("date")
    if later:
        return F.date_add(F.trunc(F.date_sub(day, later), name), later)
    return day if name == "day" else F.trunc(day, name)


def chunk_name(date_column: str, unit: str) -> Column:
    """First day of the chunk as the text used for chunk folders."""
    return F.coalesce(chunk_day(date_column, unit).cast("string"), F.lit(UNDATED))


def boundary(cutoff: datetime, unit: str) -> datetime:
    """Start of the chunk the cutoff lies in.

    Chunks before it end at or before the cutoff, so exactly the rows before the
    boundary are in wholly expired chunks. Comparing dates with this constant keeps the
    test on the scan, where computing each row's chunk would not be pushed down.
    """
    day = cutoff.replace(hour=0, minute=0, second=0, microsecond=0)
    unit, later = split_unit(unit)
    if unit == "week":
        return day - timedelta(days=(day.weekday() - later) % 7)
    if unit == "month":
        return day.replace(day=1)
    if unit == "year":
        return day.replace(month=1, day=1)
    return day


def chunk_inventory(df: DataFrame, date_column: str, unit: str, cutoff: datetime) -> DataFrame:
    """Chunks in start order: start, end, rows, and whether the chunk is wholly expired."""
    start = F.col("_day").cast("timestamp_ntz")
    limit = F.lit(boundary(cutoff, unit).date().isoformat()).cast("date")
    return (
        df.filter(F.col(f"`{date_column}`").isNotNull())
        .groupBy(chunk_day(date_column, unit).alias("_day"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            start.alias("chunk_start"),
            (start + F.expr(f"INTERVAL {_LENGTH[split_unit(unit)[0]]}")).alias("chunk_end"),
            "rows",
            (F.col("_day") < limit).alias("expired"),
        )
        .orderBy("chunk_start")
    )


def droppable_chunks(hot: DataFrame, archived: DataFrame, date_column: str,
                     unit: str, cutoff: datetime) -> DataFrame:
    """Wholly expired chunks whose rows are all archived, as `(chunk, rows)`.

    A chunk qualifies when count and digest of all columns agree on both sides. A row that came
    in or was changed after the archive was taken changes them, so it is never dropped
    unseen. Each side is reduced to one row per chunk before anything is joined.
    """
    limit = boundary(cutoff, unit)

    def totals(df):
        return grouped_totals(expired(df, date_column, limit), {"_day": chunk_day(date_column, unit)})

    kept = totals(archived).select("_day", F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
    return (
        totals(hot).join(kept, "_day")
        .filter((F.col("rows") == F.col("_rows")) & (F.col("digest") == F.col("_digest")))
        .select(F.col("_day").cast("string").alias("chunk"), "rows")
    )
