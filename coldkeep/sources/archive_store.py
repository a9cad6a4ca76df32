"""Archived runs on any Hadoop file system.

    <root>/<database>/<table>/cutoff_date=YYYY-MM-DD/run_id=<id>/part-*.parquet
    <root>/_manifest/<database>/<table>/cutoff_date=.../run_id=.../    one row per file
    <root>/_pending/run_id=<id>/...                                    a run being written

The date is the cutoff, not the date of the rows or of the run. Spark readers skip
names that start with '_', so a run is invisible until its folders are moved out of
`_pending`. Rows are moved first and the manifest last, so a manifest marks a run as
complete; the manifest carries each file's row count and content digest.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import date, datetime, timezone
from decimal import Decimal
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldkeep.functions.digest import file_totals, grouped_totals
from coldkeep.functions.names import sanitize
from coldkeep.model import ArchiveIncomplete, NoArchiveFiles, RunExists, Selection, check_run_id
from coldkeep.operators.batches import in_exact_batches, in_key_order, roll_over, writer_task
from coldkeep.session import small_frame
from coldkeep.sources.fs import Files

MANIFEST_SCHEMA = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("digest", T.DecimalType(38, 0)),
    T.StructField("schema_json", T.StringType()),
    T.StructField("published_at", T.TimestampNTZType()),
])
# Only these are archive files; whatever else lies in a run folder is not read.
ARCHIVE_FILES = "*.parquet"
# Run folders hold nothing but archive files, so their entries can be counted.
NO_MARKER = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
# Marks a pending run whose tables were all staged and checked.
_CHECKED = "_checked"
ORDERS = ("key", "exact", "scan")
RUN_COLUMNS = [T.StructField("cutoff_date", T.StringType()), T.StructField("run_id", T.StringType())]


def _schema_text(schema: T.StructType) -> str:
    return json.dumps(json.loads(schema.json()), sort_keys=True)


@dataclass(frozen=True)
class Run:
    """One archived (table, cutoff date, run id) and its folder below the table folder."""

    database: str
    table: str
    cutoff_date: str
    run_id: str

    @property
    def folder(self) -> str:
        return f"cutoff_date={self.cutoff_date}/run_id={self.run_id}"


class Totals(NamedTuple):
    """What a set of archive files holds."""

    rows: int
    digest: Decimal
    files: int


class ArchiveStore:
    """Archived runs under one root.

    With `in_place`, for object stores where moving a folder means copying it, rows are
    written where they will stay and only the small manifest is moved. A run then exists
    for this store once it has a manifest; other readers of the folder could see the rows
    of an unfinished run. `write_options` go to Spark's Parquet writer, `parquet.block.size` for instance.
    """

    def __init__(self, spark: SparkSession, root: str, in_place: bool = False, write_options: dict[str, str] | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.in_place = in_place
        self.write_options = {**(write_options or {}), **NO_MARKER}
        self.files = Files(spark)
        # A published run never changes, so neither does its schema.
        self._schemas: dict[Run, str] = {}

    # -- paths ------------------------------------------------------------------

    def table_path(self, database: str, table: str) -> str:
        return f"{self.root}/{sanitize(database)}/{sanitize(table)}"

    def manifest_path(self, database: str, table: str) -> str:
        return f"{self.root}/_manifest/{sanitize(database)}/{sanitize(table)}"

    def run_path(self, run: Run) -> str:
        return f"{self.table_path(run.database, run.table)}/{run.folder}"

    def run_manifest_path(self, run: Run) -> str:
        return f"{self.manifest_path(run.database, run.table)}/{run.folder}"

    def pending_path(self, run_id: str) -> str:
        return f"{self.root}/_pending/run_id={check_run_id(run_id)}"

    def _staged(self, run: Run, kind: str) -> str:
        return f"{self.pending_path(run.run_id)}/{kind}/{sanitize(run.database)}/{sanitize(run.table)}/{run.folder}"

    # -- writing ----------------------------------------------------------------

    def open_run(self, run_id: str) -> None:
        """Claim a run id; staging twice under one id is an error."""
        if self.files.exists(self.pending_path(run_id)):
            raise RunExists(f"run {run_id} is already being written")
        self.files.make_directory(self.pending_path(run_id))

    def stage(self, run: Run, rows: DataFrame, key: tuple[str, ...], batch_size: int,
              published_at: datetime, order: str = "scan") -> Totals:
        """Write rows to the pending area with at most `batch_size` per file.

        `order` is "scan" for the order of the source, without any shuffle, "key" for files
        in key order (one range shuffle), or "exact" for whole batches as well (one write
        and shuffle more). The totals returned, like the staged manifest, come
        from reading the files back. Staging no rows is an error.
        """
        if order not in ORDERS:
            raise ValueError(f"order must be one of {ORDERS}")
        if self.runs(run.database, run.table, Selection(run_id=run.run_id)):
            raise RunExists(f"run {run.run_id} of {run.table} is already published")
        taken = [c for c in rows.columns if c.lower() in ("cutoff_date", "run_id")]
        if taken:
            raise ValueError(f"{run.table}: column(s) {taken} have the names of archive folders")
        target = self._staged(run, "rows")
        if self.in_place:
            # Says whose rows to remove if the run is dropped.
            self.files.make_directory(target)
            target = self.run_path(run)
        schema = rows.schema
        self._schemas[run] = _schema_text(schema)
        if order == "exact":
            rows = in_exact_batches(self.spark, rows, key, batch_size)
        elif order == "key":
            rows = in_key_order(rows, key)
        rows.write.options(maxRecordsPerFile=batch_size, **self.write_options).parquet(target)
        staged = self.spark.read.schema(schema).parquet(target)
        manifest_target = self._staged(run, "manifest")
        file_totals(staged).select(
            "file_name", "rows", "digest",
            F.lit(self._schemas[run]).alias("schema_json"),
            F.lit(published_at.isoformat(sep=" ")).cast("timestamp_ntz").alias("published_at"),
        ).write.parquet(manifest_target)
        manifest = self.spark.read.schema(MANIFEST_SCHEMA).parquet(manifest_target)
        found = manifest.agg(F.sum("rows"), F.sum("digest"), F.count(F.lit(1))).first()
        if not found[0]:
            raise ValueError(f"no rows to archive for {run.table}")
        return Totals(*found)

    def publish(self, runs: list[Run]) -> None:
        """Move staged and checked runs to their final place: rows first, manifest last.

        Calling it again after an interruption finishes what is left.
        """
        for run_id in {r.run_id for r in runs}:
            self.files.write_text(f"{self.pending_path(run_id)}/{_CHECKED}", "", overwrite=True)
        for run in runs:
            if not self.in_place and self.files.exists(self._staged(run, "rows")):
                self.files.rename(self._staged(run, "rows"), self.run_path(run))
            if self.files.exists(self._staged(run, "manifest")):
                self.files.rename(self._staged(run, "manifest"), self.run_manifest_path(run))
        for run_id in {r.run_id for r in runs}:
            self.drop_pending(run_id)

    def _runs_in_pending(self, run_id: str) -> list[Run]:
        found = set()
        for path in self.files.glob(f"{self.pending_path(run_id)}/*/*/*/cutoff_date=*/run_id={run_id}"):
            database, table, day, _ = path.split("/")[-4:]
            found.add(Run(database, table, day.split("=", 1)[1], run_id))
        return sorted(found, key=lambda r: (r.database, r.table))

    def drop_pending(self, run_id: str) -> None:
        """Drop everything of a run that is not published, as one unit."""
        if self.in_place:
            for run in self._runs_in_pending(run_id):
                if not self.files.exists(self.run_manifest_path(run)):
                    self.files.delete(self.run_path(run))
        self.files.delete(self.pending_path(run_id))

    def pending_runs(self) -> list[str]:
        return [d.split("=", 1)[1] for d in self.files.directories(f"{self.root}/_pending")]

    def recover(self) -> tuple[list[Run], list[str]]:
        """Tidy up after a driver that died: finish checked runs, drop the others.

        Returns what was published, for `purge_run`, and the run ids that were dropped.
        It must not run next to a job that is staging.
        """
        published, dropped = [], []
        for run_id in self.pending_runs():
            found = self.resume(run_id)
            published += found
            if not found:
                dropped.append(run_id)
        return published, dropped

    def delete(self, run: Run) -> None:
        """Remove one published run: rows first, so an interrupted deletion is still listed and can be repeated."""
        self._schemas.pop(run, None)
        self.files.delete(self.run_path(run))
        self.files.delete(self.run_manifest_path(run))

    def resume(self, run_id: str) -> list[Run]:
        """Finish a run that was staged and checked, or drop it; returns what was published."""
        if not self.files.exists(f"{self.pending_path(run_id)}/{_CHECKED}"):
            self.drop_pending(run_id)
            return []
        found = self._runs_in_pending(run_id)
        self.publish(found)
        self.drop_pending(run_id)
        return found

    def stored(self, runs: list[Run]) -> list[Run]:
        """Those of some runs (of one table) that have a folder of rows; one listing for all."""
        return self._present(self.table_path(runs[0].database, runs[0].table), runs) if runs else []

    def recorded(self, runs: list[Run]) -> list[Run]:
        """Those of some runs (of one table) that have a manifest; one listing for all."""
        return self._present(self.manifest_path(runs[0].database, runs[0].table), runs) if runs else []

    def _present(self, base: str, runs: list[Run]) -> list[Run]:
        there = {"/".join(path.split("/")[-2:]) for path in self.files.glob(f"{base}/cutoff_date=*/run_id=*")}
        return [r for r in runs if r.folder in there]

    def record(self, run: Run) -> None:
        """Give a run of another writer its manifest, dated by its newest file, so that it ages like any other."""
        found = self.by_schema([run])
        if not found:
            raise ArchiveIncomplete(f"run {run.run_id} of {run.table} has no readable file")
        [(schema, _)] = found
        changed = max(ms for name, _, ms in self.files.files(self.run_path(run)) if name.endswith(".parquet"))
        at = datetime.fromtimestamp(changed / 1000, timezone.utc).replace(tzinfo=None)
        rows = self.spark.read.schema(schema).option("pathGlobFilter", ARCHIVE_FILES).parquet(self.run_path(run))
        draft = f"{self.root}/_drafts/{sanitize(run.database)}/{sanitize(run.table)}/{run.folder}"
        self.files.delete(draft)
        file_totals(rows).select(
            "file_name", "rows", "digest", F.lit(_schema_text(schema)).alias("schema_json"),
            F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz").alias("published_at"),
        ).write.parquet(draft)
        self.files.rename(draft, self.run_manifest_path(run))

    # -- finding ----------------------------------------------------------------

    def runs(self, database: str, table: str, selection: Selection = Selection(),
             required: bool = False) -> list[Run]:
        """Runs of one table that match a selection, by folder names alone.

        Includes runs known only from their manifest, whose files are gone. Runs without
        a manifest, such as those of another writer, are only taken from a store that is
        not `in_place`.
        """
        wanted = f"cutoff_date={selection.cutoff_date or '*'}/run_id={selection.run_id or '*'}"
        found = set()
        bases = [self.manifest_path(database, table)]
        if not self.in_place:
            bases.append(self.table_path(database, table))
        for base in bases:
            for path in self.files.glob(f"{base}/{wanted}"):
                day, run_id = (part.split("=", 1)[1] for part in path.split("/")[-2:])
                found.add(Run(database, table, day, run_id))
        if required and not found:
            raise NoArchiveFiles(f"no archive of {database}.{table} matches {selection}")
        return sorted(found, key=lambda r: (r.cutoff_date, r.run_id))

    def read_paths(self, base: str, schema: T.StructType, paths: list[str], **options) -> DataFrame:
        """Parquet folders of one table with cutoff date and run id as text columns.

        The explicit schema keeps a run id such as 12e45678 from being read as a number.
        """
        full = T.StructType([*schema.fields, *RUN_COLUMNS])
        reader = self.spark.read.schema(full).options(basePath=base, pathGlobFilter=ARCHIVE_FILES, **options)
        return reader.parquet(*paths)

    def manifest(self, runs: list[Run]) -> DataFrame:
        """One row per recorded file of these runs (of one table)."""
        recorded = self.recorded(runs)
        if not recorded:
            return small_frame(self.spark, [], T.StructType([*MANIFEST_SCHEMA.fields, *RUN_COLUMNS]))
        base = self.manifest_path(recorded[0].database, recorded[0].table)
        return self.read_paths(base, MANIFEST_SCHEMA, [self.run_manifest_path(r) for r in recorded])

    def batches(self, runs: list[Run]) -> DataFrame:
        """The manifest with each file's 0-based batch number in key order within its run."""
        files = self.manifest(runs).withColumn("_part", writer_task(F.col("file_name")))
        run = ["cutoff_date", "run_id"]
        # Counts per writer task first, so the window sees at most one row per task.
        before = Window.partitionBy(*run).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = (
            files.groupBy(*run, "_part").agg(F.count(F.lit(1)).alias("_files"))
            .withColumn("_start", F.coalesce(F.sum("_files").over(before), F.lit(0)))
            .drop("_files")
        )
        return (
            files.join(starts, [*run, "_part"])
            .withColumn("batch", F.col("_start") + roll_over(F.col("file_name")))
            .drop("_part", "_start")
        )

    def _infer_schema(self, run: Run) -> str | None:
        """Schema of a run without a manifest, from whatever footers can be read."""
        reader = self.spark.read.options(ignoreCorruptFiles="true", mergeSchema="true", pathGlobFilter=ARCHIVE_FILES)
        try:
            return _schema_text(reader.parquet(self.run_path(run)).schema)
        except AnalysisException:
            return None

    def by_schema(self, runs: list[Run]) -> list[tuple[T.StructType, list[Run]]]:
        """Runs grouped by the schema of their files.

        Schemas come from the manifest: one small job, and few distinct values however
        many runs there are. A run without a manifest has its footers read, and is left
        out if none of them is readable.
        """
        stored = self.stored(runs)
        unknown = [r for r in stored if r not in self._schemas]
        if unknown:
            recorded = self.manifest(unknown).select("cutoff_date", "run_id", "schema_json").distinct().collect()
            by_folder = {(r["cutoff_date"], r["run_id"]): r["schema_json"] for r in recorded}
            for run in unknown:
                known = by_folder.get((run.cutoff_date, run.run_id)) or self._infer_schema(run)
                if known is not None:
                    self._schemas[run] = known
        groups: dict[str, list[Run]] = {}
        for run in stored:
            if run in self._schemas:
                groups.setdefault(self._schemas[run], []).append(run)
        return [(T.StructType.fromJson(json.loads(s)), members) for s, members in groups.items()]

    def read(self, runs: list[Run], **options) -> list[DataFrame]:
        """The rows of these runs (of one table), one DataFrame per distinct file schema."""
        return [
            self.read_paths(
                self.table_path(members[0].database, members[0].table), schema,
                [self.run_path(r) for r in members], **options,
            )
            for schema, members in self.by_schema(runs)
        ]

    def check_complete(self, runs: list[Run]) -> None:
        """Raise if stored files of these runs hold other rows than were recorded.

        Rows and content digest per run, from the manifest and from a full read. A run without
        a manifest passes if it can be read at all.
        """
        readable = {r for _, members in self.by_schema(runs) for r in members}
        recorded = {
            (r["cutoff_date"], r["run_id"]): (r["rows"], r["digest"])
            for r in self.manifest(runs).groupBy("cutoff_date", "run_id").agg(
                F.sum("rows").alias("rows"), F.sum("digest").alias("digest")).collect()
        }
        stored: dict[tuple[str, str], tuple] = {}
        for df in self.read(runs):
            by = {c.name: F.col(c.name) for c in RUN_COLUMNS}
            for r in grouped_totals(df, by, [c for c in df.columns if c not in by]).collect():
                stored[r["cutoff_date"], r["run_id"]] = (r["rows"], r["digest"])
        # One entry per run on the driver.
        bad = [
            r.run_id for r in runs
            if r not in readable
            or recorded.get((r.cutoff_date, r.run_id), stored.get((r.cutoff_date, r.run_id)))
            != stored.get((r.cutoff_date, r.run_id))
        ]
        if bad:
            raise ArchiveIncomplete(f"archived runs {bad} of {runs[0].table} do not hold the rows that were recorded")


def cutoff_date(cutoff: datetime) -> str:
    """The date part that names an archive folder."""
    return date(cutoff.year, cutoff.month, cutoff.day).isoformat()
