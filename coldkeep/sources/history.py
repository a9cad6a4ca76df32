"""The run history: an append-only set of Parquet segments, one event per run and table.

    <path>/<low>-<high>-<events>-<unique>.parquet     low and high: start times, microseconds
    <path>/_merging/<segment>.json                     the segments that this one replaces

A call of `record` adds one segment, by a rename, so calls may overlap. `merge` brings small segments
together. Names carry time bounds and counts, so the newest events are found by opening the newest
segments, and merging is planned without opening any.
"""

from __future__ import annotations

import json
import re
import secrets
import time
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldkeep.model import RetentionError
from coldkeep.operators.reports import HISTORY_LIMIT, recent
from coldkeep.session import small_frame
from coldkeep.sources.fs import Files

HISTORY_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("files", T.ArrayType(T.StringType())),
    T.StructField("status", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("start_time", T.TimestampNTZType()),
    T.StructField("end_time", T.TimestampNTZType()),
])
#: Events that a merged segment is filled up to.
SEGMENT_EVENTS = 100_000
_NAME = re.compile(r"(\d+)-(\d+)-(\d+)-[0-9a-f]+\.parquet")
_EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class Event:
    """What a planned, finished or failed step on one table leaves behind.

    `files` names the run folders, one per run and table. The single files in them are
    rows of the archive manifest: a run may have more of them than one cell should hold.
    """

    run_id: str
    rule: str
    event_type: str
    table_name: str
    row_count: int
    files: tuple[str, ...]
    status: str
    error_message: str
    start_time: datetime
    end_time: datetime


class Segment(NamedTuple):
    """A file of events, with what its name says. A file of another name may hold events of any time."""

    name: str
    low: int
    high: int
    events: int

    @classmethod
    def named(cls, name: str) -> Segment:
        found = _NAME.fullmatch(name)
        return cls(name, *map(int, found.groups())) if found else cls(name, 0, 1 << 63, 0)


def _micros(at: datetime | None) -> int:
    return max(0, (at - _EPOCH) // timedelta(microseconds=1)) if at else 0


class History:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.files = Files(spark)

    def segments(self) -> list[Segment]:
        """The segments that count: without those that a merge has replaced and not yet deleted."""
        names = [n for n in self.files.names(self.path) if n.endswith(".parquet")]
        merges = [n for n in self.files.names(f"{self.path}/_merging") if n.endswith(".json")]
        replaced = {old for m in merges if m[:-5] in names for old in self._replaces(m)}
        return [Segment.named(n) for n in names if n not in replaced]

    def _replaces(self, merge: str) -> list[str]:
        return json.loads(self.files.read_text(f"{self.path}/_merging/{merge}"))

    def read(self, segments: list[Segment]) -> DataFrame:
        if not segments:
            return small_frame(self.spark, [], HISTORY_SCHEMA)
        return self.spark.read.schema(HISTORY_SCHEMA).parquet(*[f"{self.path}/{s.name}" for s in segments])

    def df(self) -> DataFrame:
        return self.read(self.segments())

    def recent(self, rule: str | None = None, limit: int = HISTORY_LIMIT) -> DataFrame:
        """The newest events, as `reports.recent` gives them, from as few of the newest segments as hold them."""
        todo, opened, width = sorted(self.segments(), key=lambda s: (-s.high, s.name)), [], 1
        while todo:
            opened, todo, width = opened + todo[:width], todo[width:], 2 * width
            newest = recent(self.read(opened), rule, limit)
            if todo:
                [(found, oldest)] = newest.agg(F.count(F.lit(1)), F.min("start_time")).collect()
                if found == limit and oldest is not None and _micros(oldest) > todo[0].high:
                    break
        return recent(self.read(opened), rule, limit)

    def record(self, events: list[Event]) -> None:
        """Append events. Ids rise with the time of recording and need no read of the history.

        An id is the microsecond of recording, plus the place in the call, and ten random bits,
        so that jobs that record at the same moment differ.
        """
        if not events:
            return
        now = time.time_ns() // 1_000
        names = HISTORY_SCHEMA.fieldNames()[1:]
        rows = [
            ((now + i) << 10 | secrets.randbits(10), *[getattr(event, n) for n in names]) for i, event in enumerate(events)
        ]
        times = [_micros(e.start_time) for e in events]
        draft = self._drafted(small_frame(self.spark, rows, HISTORY_SCHEMA))
        self._place(draft, self._name(min(times), max(times), len(events)))

    def adopt(self, events: DataFrame) -> None:
        """Append events of another history, with their ids, as one segment."""
        draft = self._drafted(events.select(*HISTORY_SCHEMA.fieldNames()))
        self._place(draft, self._name_of(draft))

    def _name_of(self, draft: str) -> str:
        events = self.spark.read.schema(HISTORY_SCHEMA).parquet(draft)
        n, low, high = events.agg(F.count(F.lit(1)), F.min("start_time"), F.max("start_time")).first()
        return self._name(_micros(low), _micros(high), n)

    def _name(self, low: int, high: int, events: int) -> str:
        return f"{low}-{high}-{events}-{uuid.uuid4().hex}.parquet"

    def _drafted(self, events: DataFrame) -> str:
        folder = f"{self.path}/_drafts/{uuid.uuid4().hex}"
        events.coalesce(1).write.parquet(folder)
        return folder

    def _place(self, draft: str, name: str) -> None:
        """Give the one file of a draft its name; from then on it counts."""
        [part] = [n for n in self.files.names(draft) if n.endswith(".parquet")]
        self.files.rename(f"{draft}/{part}", f"{self.path}/{name}")
        self.files.delete(draft)

    def merge(self, events: int = SEGMENT_EVENTS) -> int:
        """Bring neighbouring small segments together, up to so many events each; returns how many went.

        What a merge replaces is written down before the merged segment appears, so readers count every
        event once at any moment, and the next merge deletes what an interrupted one left. One merge at a time.
        """
        gone = self._finish_merges()
        groups: list[list[Segment]] = [[]]
        for segment in sorted(self.segments(), key=lambda s: (s.low, s.high, s.name)):
            if groups[-1] and sum(s.events for s in groups[-1]) + segment.events > events:
                groups.append([])
            groups[-1].append(segment)
        for group in groups:
            if len(group) < 2:
                continue
            rows = self.read(group).orderBy("start_time", "id")
            draft = self._drafted(rows)
            bounds = F.count(F.lit(1)).alias("n"), F.sum(F.col("id").cast("decimal(38,0)")).alias("ids")
            written = self.spark.read.schema(HISTORY_SCHEMA).parquet(draft)
            if written.agg(*bounds).first() != rows.agg(*bounds).first():
                self.files.delete(draft)
                raise RetentionError(f"merging {len(group)} segments of {self.path} changed their events")
            name = self._name_of(draft)
            self.files.write_text(f"{self.path}/_merging/{name}.json", json.dumps([s.name for s in group]))
            self._place(draft, name)
            gone += self._finish_merges()
        return gone

    def _finish_merges(self) -> int:
        gone = 0
        names = set(self.files.names(self.path))
        for merge in self.files.names(f"{self.path}/_merging"):
            if merge[:-5] in names:
                for old in self._replaces(merge):
                    gone += self.files.delete(f"{self.path}/{old}")
            self.files.delete(f"{self.path}/_merging/{merge}")
        return gone
