"""What files the runs of a table have."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from coldkeep.operators.verify import FACT_SCHEMA, FILE_KEY
from coldkeep.session import small_frame
from coldkeep.sources.archive_store import ARCHIVE_FILES, ArchiveStore, Run
from coldkeep.sources.task_files import listed

_RUN = ["cutoff_date", "run_id"]
_LISTING_SCHEMA = T.StructType([
    *[f for f in FACT_SCHEMA if f.name in (*FILE_KEY, "length")], T.StructField("modified_at", T.TimestampType()),
])
_FOLDERS = T.StructType([T.StructField(n, T.StringType()) for n in (*_RUN, "folder")])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [
            (day, run_id, name, length, changed)
            for day, run_id, folder in zip(*(batch.column(n).to_pylist() for n in (*_RUN, "folder")))
            for name, length, changed in listed(folder)
            if fnmatch(name, ARCHIVE_FILES) and not name.startswith(("_", "."))
        ]
        columns = list(zip(*found)) or [()] * 5
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _LISTING_SCHEMA.fieldNames())


def list_files(store: ArchiveStore, runs: list[Run]) -> DataFrame:
    """Every stored archive file of these runs (of one table) with its size and age, empty files too.

    Folder names are dealt to tasks, which list them; the driver makes no call per run or file.
    """
    if not runs:
        return small_frame(store.spark, [], _LISTING_SCHEMA)
    root, known = store.files.qualified(store.root), len(store.root)
    rows = [(r.cutoff_date, r.run_id, root + store.run_path(r)[known:]) for r in runs]
    tasks = min(len(rows), 4 * store.spark.sparkContext.defaultParallelism)
    return small_frame(store.spark, rows, _FOLDERS).repartition(tasks).mapInArrow(_listed, _LISTING_SCHEMA)
