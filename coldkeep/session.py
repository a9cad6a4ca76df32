"""Session settings the engine relies on, and the shared working folder."""

from __future__ import annotations

import contextvars
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from coldkeep.sources.fs import Files

# Time zone: RFC3339 text and cutoffs are UTC. ANSI: narrowing casts must fail, not wrap.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

_local_workspaces: dict[str, str] = {}
# Folders of the job that is running, or of no job.
_folders: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("folders", default=None)
_left: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings that change results."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def workspace(spark: SparkSession, purpose: str) -> str:
    """A fresh folder on storage that driver and executors share.

    It lies under `spark.checkpoint.dir`. A session of one process (`local[...]`) may leave
    that unset, as in tests, and gets a temporary folder; with executors of their own
    (`local-cluster` included) the setting is required, because a machine-local folder is
    not seen by all of them. A job's folders go when the job ends (`own_folders`).
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = context.applicationId
        if app not in _local_workspaces:
            _local_workspaces[app] = "file:" + tempfile.mkdtemp(prefix="coldkeep-")
        base = _local_workspaces[app]
    folder = f"{base.rstrip('/')}/coldkeep/{purpose}-{uuid.uuid4().hex}"
    owned = _folders.get()
    (_left if owned is None else owned).append(folder)
    return folder


def release(spark: SparkSession) -> int:
    """Delete the working folders that belong to no job; returns how many there were.

    Those of running jobs stay. DataFrames that still read the others become unusable.
    """
    files = Files(spark)
    count = len(_left)
    while _left:
        files.delete(_left.pop())
    return count


@contextmanager
def own_folders(spark: SparkSession) -> Iterator[None]:
    """A job whose working folders are deleted when it ends, well or not.

    Its result must not read them. Threads of `together` belong to the job; a job
    within a job has folders of its own.
    """
    folders: list[str] = []
    token = _folders.set(folders)
    try:
        yield
    finally:
        _folders.reset(token)
        files = Files(spark)
        for folder in folders:
            files.delete(folder)


def written(spark: SparkSession, df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder, read back.

    It cuts the lineage in a way that survives lost executors, and gives the optimizer
    the real size: it will broadcast the table only if it really is small.
    """
    folder = workspace(spark, purpose)
    schema = df.schema
    df.write.parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def small_frame(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType) -> DataFrame:
    """A DataFrame of a few driver-side rows (events, run summaries, file offsets).

    It goes over as Arrow and becomes a local relation, whose size the optimizer knows
    and which needs no Python worker.
    """
    names = schema.fieldNames()
    table = pa.Table.from_pylist([dict(zip(names, row)) for row in rows], schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


def together(spark: SparkSession, work: list[Callable], at_once: int = 4) -> list:
    """Run independent jobs side by side, so small ones do not leave executors idle.

    Waits for all of them; the first failure, if any, is raised after that.
    """
    if len(work) < 2:
        return [step() for step in work]
    with ThreadPoolExecutor(max_workers=min(len(work), at_once)) as pool:
        waiting = [pool.submit(contextvars.copy_context().run, inheritable_thread_target(spark)(step)) for step in work]
    return [w.result() for w in waiting]
