"""Digests of archive files by row group: damage is located without decoding, and unchanged files are not read.

The manifest's digests are of rows, so they need a full decode and tell which file is damaged. Those here are of the
bytes of each row group, with one more for the footer; they add up to a digest of a file and of a run. They are kept in

    <root>/_groups/<database>/<table>/cutoff_date=.../run_id=.../

A verification reads the recorded byte ranges, whatever a damaged footer says, in tasks that share a large file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldkeep.operators.verify import FILE_KEY
from coldkeep.plans.listing import list_files
from coldkeep.session import small_frame, written
from coldkeep.sources.archive_store import RUN_COLUMNS, ArchiveStore, Run
from coldkeep.sources.task_files import open_file

#: Bytes read at once.
BLOCK = 8 << 20
#: The place of the footer among the row groups.
FOOTER = -1

GROUP_SCHEMA = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("row_group", T.IntegerType()),
    T.StructField("rows", T.LongType()),
    T.StructField("first_byte", T.LongType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("digest", T.DecimalType(38, 0)),
])
_RUN = ["cutoff_date", "run_id"]
_KEY = [*FILE_KEY, "row_group"]


def _digest(file, first: int, size: int) -> int:
    """Of a range of bytes; a range that the file does not have gives another digest than it had."""
    h, left = hashlib.blake2b(digest_size=8), size
    file.seek(first)
    while left > 0:
        block = file.read(min(BLOCK, left))
        if not block:
            break
        h.update(block)
        left -= len(block)
    return int.from_bytes(h.digest(), "big")


def _ranges(file) -> list[tuple[int, int, int, int]]:
    """(row group, rows, first byte, bytes), the footer last."""
    import pyarrow.parquet as pq

    meta, out, end = pq.read_metadata(file), [], 0
    for n in range(meta.num_row_groups):
        group = meta.row_group(n)
        columns = [group.column(c) for c in range(group.num_columns)]
        starts = [min(o for o in (c.dictionary_page_offset, c.data_page_offset) if o is not None) for c in columns]
        first, end = min(starts), max(s + c.total_compressed_size for s, c in zip(starts, columns))
        out.append((n, group.num_rows, first, end - first))
    return [*out, (FOOTER, 0, end, file.size() - end)]


def _recorded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.decimal128(38, 0)]
    for batch in batches:
        rows = []
        for day, run_id, name, path in zip(*(batch.column(c).to_pylist() for c in (*FILE_KEY, "path"))):
            with open_file(path) as file:
                for group, count, first, size in _ranges(file):
                    rows.append((day, run_id, name, group, count, first, size, Decimal(_digest(file, first, size))))
        columns = list(zip(*rows)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*_RUN, *GROUP_SCHEMA.fieldNames()])


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sound = []
        for path, first, size, digest in zip(*(batch.column(c).to_pylist() for c in ("path", "first_byte", "n_bytes", "digest"))):
            try:
                with open_file(path) as file:
                    sound.append(_digest(file, first, size) == int(digest))
            except OSError:
                sound.append(False)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEY), pa.array(sound, pa.bool_())], [*_KEY, "sound"])


def _path(store: ArchiveStore, run: Run) -> Column:
    base = store.files.qualified(store.table_path(run.database, run.table))
    return F.format_string("%s/cutoff_date=%s/run_id=%s/%s", F.lit(base), *FILE_KEY).alias("path")


def _folder(store: ArchiveStore, run: Run) -> str:
    return f"{store.root}/_groups/{store.manifest_path(run.database, run.table).split('/_manifest/', 1)[1]}"


def record_row_groups(store: ArchiveStore, runs: list[Run]) -> None:
    """Write down the row groups of these runs (of one table), of which none has been yet. Their files must be sound."""
    if not runs:
        return
    files = list_files(store, runs)
    each = files.select(*FILE_KEY, _path(store, runs[0])).repartition(4 * store.spark.sparkContext.defaultParallelism)
    found = each.mapInArrow(_recorded, T.StructType([*RUN_COLUMNS, *GROUP_SCHEMA.fields]))
    found.repartition(*_RUN).write.mode("append").partitionBy(*_RUN).parquet(_folder(store, runs[0]))


def recorded_row_groups(store: ArchiveStore, runs: list[Run]) -> DataFrame:
    """What was written down of these runs (of one table)."""
    if not runs or not store.files.exists(_folder(store, runs[0])):
        return small_frame(store.spark, [], T.StructType([*GROUP_SCHEMA.fields, *RUN_COLUMNS]))
    rows = store.read_paths(_folder(store, runs[0]), GROUP_SCHEMA, [_folder(store, runs[0])])
    wanted = small_frame(store.spark, [(r.cutoff_date, r.run_id) for r in runs], T.StructType(RUN_COLUMNS))
    return rows.join(wanted, _RUN, "left_semi")


def forget_row_groups(store: ArchiveStore, run: Run) -> None:
    """Drop the digests of a run whose files were rewritten."""
    store.files.delete(f"{_folder(store, run)}/{run.folder}")


def file_digests(groups: DataFrame) -> DataFrame:
    """Row groups added up to files."""
    return groups.groupBy(*FILE_KEY).agg(
        F.sum("rows").cast("bigint").alias("rows"), F.sum("n_bytes").cast("bigint").alias("n_bytes"), F.sum("digest").cast("decimal(38,0)").alias("digest"))


def run_digests(groups: DataFrame) -> DataFrame:
    """Files added up to runs."""
    return file_digests(groups).groupBy(*_RUN).agg(
        F.count(F.lit(1)).alias("files"), F.sum("rows").cast("bigint").alias("rows"), F.sum("digest").cast("decimal(38,0)").alias("digest"))


def verify_row_groups(store: ArchiveStore, runs: list[Run], known: DataFrame | None = None) -> DataFrame:
    """Status of every recorded row group: OK, CORRUPT, or MISSING with its file; and whether it was read now.

    `known` is an earlier result. A group that was OK there is not read again while its file has the length and time of change
    that it had.
    """
    recorded = recorded_row_groups(store, runs)
    files = written(store.spark, list_files(store, runs), "files")
    groups = recorded.join(files, FILE_KEY, "left")
    if known is None:
        groups = groups.withColumn("_same", F.lit(False))
    else:
        before = known.filter("status = 'OK'").select(*_KEY, F.col("length").alias("_length"), F.col("modified_at").alias("_at"))
        groups = groups.join(before, _KEY, "left").withColumn(
            "_same", F.coalesce((F.col("length") == F.col("_length")) & (F.col("modified_at") == F.col("_at")), F.lit(False)))
    groups = written(store.spark, groups.drop("_length", "_at"), "groups")
    todo = groups.filter("length is not null and not _same")
    if runs:
        todo = todo.select(*_KEY, "first_byte", "n_bytes", "digest", _path(store, runs[0]))
    tasks = 4 * store.spark.sparkContext.defaultParallelism
    kinds = "cutoff_date string, run_id string, file_name string, row_group int, sound boolean"
    judged = todo.repartition(tasks).mapInArrow(_judged, kinds) if runs else todo.select(*_KEY, F.lit(True).alias("sound"))
    status = F.when(F.col("length").isNull(), "MISSING").when(F.col("_same") | F.col("sound"), "OK").otherwise("CORRUPT")
    return groups.join(judged, _KEY, "left").select(
        *_KEY, status.alias("status"), "rows", "length", "modified_at", F.col("sound").isNotNull().alias("read"))
