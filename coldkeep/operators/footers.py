"""Counting expired rows from Parquet footers: the date column is read only where a row group straddles the cutoff.

The footers of a file say, per row group, how many rows it has, how many dates are NULL, and the first and last date.
Groups that end before the cutoff are expired whole, groups that begin at it or later are kept whole. The rest, and groups
without such facts, are read, in the date column alone and a batch at a time. Files are dealt to tasks; the driver names folders only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import date, datetime, time, timedelta, timezone

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldkeep.functions.timestamps import cutoff_literal
from coldkeep.session import small_frame, written
from coldkeep.sources.task_files import data_files, open_file

_COUNTS = ("expired_rows", "row_groups", "row_groups_read")
_PATHS = T.StructType([T.StructField("path", T.StringType())])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([f for p in batch.column("path").to_pylist() for f in data_files(p)], pa.string())], ["path"])


def _first_kept(cutoff: datetime, value: date) -> date | None:
    """The smallest value of the kind of `value` that is kept; None if it is of no known kind."""
    if isinstance(value, datetime):
        return cutoff if value.tzinfo is None else cutoff.replace(tzinfo=timezone.utc)
    if isinstance(value, date):
        return cutoff.date() + timedelta(days=cutoff.time() != time(0))
    return None


def _by_facts(column, rows: int, cutoff: datetime) -> int | None:
    """Expired rows of a row group by what its footer says of the date column; None if it must be read."""
    facts = column.statistics
    if not rows:
        return 0
    if facts is None or not facts.has_null_count:
        return None
    if facts.null_count == rows:
        return 0
    if not facts.has_min_max:
        return None
    kept = _first_kept(cutoff, facts.min)
    if kept is None:
        return None
    if facts.max < kept:
        return rows - facts.null_count
    return 0 if facts.min >= kept else None


def _by_values(file, group: int, name: str, cutoff: datetime) -> int:
    count = 0
    for batch in file.iter_batches(row_groups=[group], columns=[name]):
        values = batch.column(0)
        kept = _first_kept(cutoff, date.min) if pa.types.is_date(values.type) else cutoff
        count += pc.sum(pc.less(values, pa.scalar(kept, values.type))).as_py() or 0
    return count


def expired_by_footers(spark: SparkSession, paths: Iterable[str], date_column: str, cutoff: datetime, data_type: T.DataType) -> DataFrame:
    """One row: expired rows of the Parquet files and folders named, their row groups, and how many of these were read.

    Same counts as a scan: a NULL date is never expired, nor is a row of a file without the column. No paths or files give zeros.
    A file that cannot be opened is an error.
    """
    cutoff_literal(cutoff, data_type)  # the same types, refused in the same way

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                with open_file(path) as raw:
                    file, total, read = pq.ParquetFile(raw), 0, 0
                    meta = file.metadata
                    names = [meta.schema.column(i).path for i in range(meta.num_columns)]
                    for group in range(meta.num_row_groups) if date_column in names else ():
                        facts = meta.row_group(group)
                        found = _by_facts(facts.column(names.index(date_column)), facts.num_rows, cutoff)
                        if found is None:
                            found, read = _by_values(file, group, date_column, cutoff), read + 1
                        total += found
                    rows.append((total, meta.num_row_groups, read))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows)) or [()] * 3], list(_COUNTS))

    paths, most = list(paths), 4 * spark.sparkContext.defaultParallelism

    def dealt(df: DataFrame, rows: int) -> DataFrame:
        return df.repartition(max(1, min(rows, most)))

    folders = dealt(small_frame(spark, [(p,) for p in paths], _PATHS), len(paths))
    files = written(spark, folders.mapInArrow(_listed, _PATHS), "files")
    each = dealt(files, files.count()).mapInArrow(counted, ", ".join(f"{c} long" for c in _COUNTS))
    return each.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in _COUNTS])
