"""Hot tables kept as Parquet folders behind a snapshot pointer.

Spark cannot overwrite a path it is reading, and a half-finished rewrite must never be
seen. So a change writes new folders and then publishes one small pointer file naming
the folders that make up the table; readers take the newest pointer. A crash before
that leaves the old snapshot in force. One writer per table at a time is assumed.

A table may be split into time chunks, one folder each. Dropping a chunk then only
leaves it out of the next pointer, and only the chunk at the cutoff is rewritten.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from datetime import date, datetime
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldkeep.model import CHUNK_UNITS, RetentionError, SchemaMismatch
from coldkeep.operators.chunks import UNDATED, chunk_name, unit_of
from coldkeep.operators.expire import expired, is_expired
from coldkeep.operators.footers import expired_by_footers
from coldkeep.operators.restore import align
from coldkeep.session import small_frame
from coldkeep.sources.fs import Files

_CHUNK = "chunk_start"
_PREFIX = f"{_CHUNK}="


@dataclass(frozen=True)
class Part:
    """One folder (or adopted file) of a table; `chunk` is the chunk it holds, if any."""

    path: str
    chunk: str | None = None


@dataclass(frozen=True)
class Snapshot:
    version: int
    schema: T.StructType
    parts: tuple[Part, ...]
    date_column: str | None
    unit: str | None

    def parts_before(self, cutoff: datetime) -> list[Part]:
        """Parts that can hold rows before the cutoff; later chunks are never read."""
        if self.unit is None:
            return list(self.parts)
        day = cutoff.date().isoformat()
        return [p for p in self.parts if p.chunk != UNDATED and p.chunk <= day]


class HotTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.files = Files(spark)

    # -- creating ---------------------------------------------------------------

    @classmethod
    def adopt(cls, spark: SparkSession, root: str, paths: list[str]) -> HotTable:
        """A table over existing Parquet paths. They are read in place, never changed."""
        table = cls(spark, root)
        parts = tuple(Part(table.files.qualified(p)) for p in paths)
        table._publish(Snapshot(0, table._common_schema(parts), parts, None, None))
        return table

    @classmethod
    def adopt_chunks(cls, spark: SparkSession, root: str, folder: str, date_column: str, unit: str) -> HotTable:
        """A chunked table over existing `chunk_start=YYYY-MM-DD` folders, read in place.

        Weeks may begin on any one weekday. Folder names that are no starts of the unit,
        and rows that lie in another chunk than their folder says, are errors.
        """
        if unit not in CHUNK_UNITS:
            raise ValueError(f"chunks need one of {CHUNK_UNITS}")
        table = cls(spark, root)
        base = table.files.qualified(folder)
        parts = [
            Part(f"{base}/{name}", name[len(_PREFIX):])
            for name in table.files.directories(folder)
            if name.startswith(_PREFIX)
        ]
        if not parts:
            raise RetentionError(f"no {_PREFIX}... folders in {folder}")
        unit = unit_of(unit, [date.fromisoformat(p.chunk) for p in parts if p.chunk != UNDATED])
        snapshot = Snapshot(0, table._common_schema(parts), tuple(parts), date_column, unit)
        rows = spark.read.schema(T.StructType([*snapshot.schema.fields, T.StructField(_CHUNK, T.StringType())])).option(
            "basePath", base).parquet(*[p.path for p in parts])
        # The folder name read as text; Spark writes and reads a NULL partition as its own default name.
        astray = rows.filter(chunk_name(date_column, unit) != F.coalesce(F.col(_CHUNK), F.lit(UNDATED))).limit(1).count()
        if astray:
            raise RetentionError(f"{folder}: rows lie in other chunks of a {unit} than their folders say")
        table._publish(snapshot)
        return table

    def _common_schema(self, parts: list[Part] | tuple[Part, ...]) -> T.StructType:
        """The columns of all parts together, from the footers of all their files."""
        try:
            return self.spark.read.option("mergeSchema", "true").parquet(*[p.path for p in parts]).schema
        except (PySparkException, Py4JJavaError) as problem:
            raise SchemaMismatch(f"the parts of {self.root} have columns of one name but different types") from problem

    def check_columns(self, parts: list[Part] | tuple[Part, ...]) -> None:
        """Raise if adopted parts hold columns the table does not know, which a read would drop."""
        adopted = [p for p in parts if ":" in p.path]
        if adopted:
            known = self.schema().fieldNames()
            extra = [c for c in self._common_schema(adopted).fieldNames() if c not in known and c != _CHUNK]
            if extra:
                raise SchemaMismatch(f"{self.root}: column(s) {extra} appeared in adopted parts; adopt them anew")

    @classmethod
    def load(cls, spark: SparkSession, root: str, df: DataFrame,
             date_column: str | None = None, unit: str | None = None,
             cluster_by: tuple[str, ...] = ()) -> HotTable:
        """Write a DataFrame as a new table, split into chunks when a unit is given."""
        if unit is not None and (unit not in CHUNK_UNITS or date_column is None):
            raise ValueError(f"chunks need a date column and one of {CHUNK_UNITS}")
        table = cls(spark, root)
        table._publish(Snapshot(0, df.schema, (), date_column, unit))
        table.append(df, cluster_by)
        return table

    # -- reading ----------------------------------------------------------------

    def snapshot(self) -> Snapshot:
        names = [n for n, _, _ in self.files.files(f"{self.root}/_snapshots") if n.endswith(".json")]
        if not names:
            raise RetentionError(f"no table at {self.root}")
        raw = json.loads(self.files.read_text(f"{self.root}/_snapshots/{max(names)}"))
        return Snapshot(
            raw["version"], T.StructType.fromJson(raw["schema"]),
            tuple(Part(**p) for p in raw["parts"]), raw["date_column"], raw["unit"],
        )

    def schema(self) -> T.StructType:
        """Column names, types and nullability, in table order; no job runs."""
        return self.snapshot().schema

    def df(self, parts: list[Part] | tuple[Part, ...] | None = None) -> DataFrame:
        """The current rows, or those of some parts only."""
        snapshot = self.snapshot()
        return self._read(snapshot.schema, snapshot.parts if parts is None else parts)

    def _read(self, schema: T.StructType, parts: list[Part] | tuple[Part, ...]) -> DataFrame:
        if not parts:
            return small_frame(self.spark, [], schema)
        return self.spark.read.schema(schema).parquet(*self.paths(parts))

    def paths(self, parts: list[Part] | tuple[Part, ...]) -> list[str]:
        """Where these parts lie."""
        return [p.path if ":" in p.path else f"{self.root}/{p.path}" for p in parts]

    def expired(self, date_column: str, cutoff: datetime) -> DataFrame:
        """Expired rows of the current snapshot, whose files never change."""
        snapshot = self.snapshot()
        return expired(self._read(snapshot.schema, snapshot.parts_before(cutoff)), date_column, cutoff)

    def expired_by_footers(self, date_column: str, cutoff: datetime) -> DataFrame:
        """How many rows of the current snapshot are expired, by footers where they tell."""
        snapshot = self.snapshot()
        paths = [self.files.qualified(p) for p in self.paths(snapshot.parts_before(cutoff))]
        return expired_by_footers(self.spark, paths, date_column, cutoff, snapshot.schema[date_column].dataType)

    def count(self) -> int:
        """Rows from the file footers."""
        return self.df().count()

    # -- changing ---------------------------------------------------------------

    def write_parts(self, df: DataFrame, version: int, cluster_by: tuple[str, ...] | None = ()) -> list[Part]:
        """Write rows to the folder of a version that is not published yet.

        Rows for a chunked table are first ranged over (chunk, date, `cluster_by`): that
        cuts a huge chunk into many tasks and keeps small ones together, so neither a
        hot chunk nor a flood of tiny files appears. Without `cluster_by` a hash of the row breaks ties, so one date with
        most rows is split as well. None says that the rows were read from chunk folders
        and already lie together, so nothing is shuffled.
        """
        snapshot = self.snapshot()
        folder = f"v={version}"
        target = f"{self.root}/{folder}"
        # Left over from an attempt that never published.
        self.files.delete(target)
        if snapshot.unit is None:
            df.write.parquet(target)
            return [Part(folder)]
        df = df.withColumn(_CHUNK, chunk_name(snapshot.date_column, snapshot.unit))
        if cluster_by is not None:
            rest = [c for c in cluster_by if c != snapshot.date_column]
            if not rest:
                rest = [F.xxhash64(*[c for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)])]
            df = df.repartitionByRange(_CHUNK, snapshot.date_column, *rest)
        df.write.partitionBy(_CHUNK).parquet(target)
        return [
            Part(f"{folder}/{name}", name[len(_PREFIX):])
            for name in self.files.directories(target)
            if name.startswith(_PREFIX)
        ]

    def by_file(self, parts: list[Part], date_column: str, cutoff: datetime) -> tuple[list[Part], list[Part]]:
        """Parts of a table in one piece as single files: those with expired rows, and the others.

        Reads the date column; one entry per file comes to the driver, as it goes into the pointer.
        """
        rows = self.df(parts)
        counted = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(
            F.count_if(is_expired(rows, date_column, cutoff)).alias("n")).collect()
        root = f"{self.files.qualified(self.root)}/"
        touched, others = [], []
        for r in sorted(counted, key=lambda r: r["path"]):
            path = self.files.qualified(unquote(r["path"])).removeprefix(root)
            (touched if r["n"] else others).append(Part(path))
        return touched, others

    def replace(self, remove: list[Part], add: DataFrame | None = None, keep: list[Part] = []) -> None:
        """Publish a snapshot without some parts, with the files of them that stay as they are (`keep`)
        and the rows of the others that stay."""
        snapshot = self.snapshot()
        version = snapshot.version + 1
        kept = [*(p for p in snapshot.parts if p not in remove), *keep]
        added = self.write_parts(add, version, None) if add is not None else []
        self._publish(replace(snapshot, version=version, parts=(*kept, *added)))

    def append(self, df: DataFrame, cluster_by: tuple[str, ...] = ()) -> None:
        """Add rows, matched by column name; existing folders are not touched.

        A column the table lacks is added to it and is NULL in older rows. Types may be
        narrower than the table's, never wider.
        """
        snapshot = self.snapshot()
        version = snapshot.version + 1
        known = snapshot.schema.fieldNames()
        more = [T.StructField(f.name, f.dataType) for f in df.schema.fields if f.name not in known]
        schema = T.StructType([*snapshot.schema.fields, *more])
        added = self.write_parts(align(df, schema), version, cluster_by)
        self._publish(replace(snapshot, version=version, schema=schema, parts=(*snapshot.parts, *added)))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete pointers but the newest `keep` and every folder of this table that none
        of those names; returns the folders. Adopted paths outside the table are kept.

        Purged rows stay on disk until this runs. It must not run next to a writer, nor
        while older snapshots are still being read.
        """
        names = sorted(n for n, _, _ in self.files.files(f"{self.root}/_snapshots") if n.endswith(".json"))
        used = set()
        for name in names[-keep:]:
            raw = json.loads(self.files.read_text(f"{self.root}/_snapshots/{name}"))
            used |= {p["path"] for p in raw["parts"]}
        for name in names[:-keep]:
            self.files.delete(f"{self.root}/_snapshots/{name}")
        gone = []
        for version in (d for d in self.files.directories(self.root) if d.startswith("v=")):
            chunks = [f"{version}/{d}" for d in self.files.directories(f"{self.root}/{version}")]
            unused = [c for c in chunks if c not in used] if any(c in used for c in chunks) else [version]
            for folder in unused:
                if folder in used:
                    continue
                # A folder some files of which are named loses the others.
                named = {u for u in used if u.startswith(f"{folder}/")}
                files = [f"{folder}/{name}" for name, _, _ in self.files.files(f"{self.root}/{folder}")] if named else []
                for path in [f for f in files if f not in named] if named else [folder]:
                    self.files.delete(f"{self.root}/{path}")
                    gone.append(path)
        return gone

    def _publish(self, snapshot: Snapshot) -> None:
        name = f"{snapshot.version:020d}.json"
        body = json.dumps({
            "version": snapshot.version,
            "schema": json.loads(snapshot.schema.json()),
            "parts": [asdict(p) for p in snapshot.parts],
            "date_column": snapshot.date_column,
            "unit": snapshot.unit,
        })
        draft = f"{self.root}/_snapshots/{name}.draft"
        self.files.write_text(draft, body, overwrite=True)
        self.files.rename(draft, f"{self.root}/_snapshots/{name}")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
