"""History queries, reconciliation and archive ageing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldkeep.functions.timestamps import duration_micros
from coldkeep.model import LifecyclePolicy

# Fixed value: events listed when the caller does not say.
HISTORY_LIMIT = 20


def recent(history: DataFrame, rule: str | None = None, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Newest events first, ties broken by id; a per-partition top-n, not a full sort."""
    if rule is not None:
        history = history.filter(F.col("rule") == rule)
    return history.orderBy(F.col("start_time").desc(), F.col("id").desc()).limit(limit)


def with_duration(history: DataFrame) -> DataFrame:
    return history.withColumn("duration_us", duration_micros(F.col("start_time"), F.col("end_time")))


def files_as_json(history: DataFrame) -> DataFrame:
    """The file list as JSON text."""
    return history.withColumn("files", F.to_json("files"))


def files_from_json(history: DataFrame) -> DataFrame:
    """JSON text back to the file list."""
    return history.withColumn("files", F.from_json("files", "array<string>"))


def expected_rows(history: DataFrame) -> DataFrame:
    """Rows each successful archive run recorded, per run and table."""
    done = history.filter((F.col("event_type") == "archive") & (F.col("status") == "success"))
    return done.groupBy("run_id", "table_name").agg(F.sum("row_count").cast("bigint").alias("expected_rows"))


def actual_rows(verified: DataFrame) -> DataFrame:
    """Rows found in sound files, per run and table; a run without one does not appear."""
    return (
        verified.filter(F.col("status") == "OK")
        .groupBy("run_id", "table_name")
        .agg(F.sum("rows").cast("bigint").alias("actual_rows"))
    )


# Lifecycle event and the status of a run that it explains.
GONE = {"expire": "expired", "move": "moved"}


def gone_runs(history: DataFrame) -> DataFrame:
    """Runs that lifecycle steps took away, with the last such step, per run and table.

    Of a step that was planned and never marked as done it is not known how far it came: `interrupted`.
    """
    steps = history.filter(F.col("event_type").isin(list(GONE)))
    done = F.col("status") == "success"
    last = steps.groupBy("run_id", "table_name").agg(
        F.max_by(F.when(done, F.col("event_type")), F.when(done, F.struct("start_time", "id"))).alias("_step"),
        F.max(F.col("status") == "planned").alias("_planned"))
    names = F.create_map(*[F.lit(x) for pair in GONE.items() for x in pair])
    gone = F.coalesce(names[F.col("_step")], F.when(F.col("_planned"), "interrupted"))
    return last.select("run_id", "table_name", gone.alias("_gone"))


def open_steps(history: DataFrame) -> DataFrame:
    """Lifecycle steps that were planned and not marked as done since, with the folder of their run."""
    steps = history.filter(F.col("event_type").isin(list(GONE))).withColumn("folder", F.get("files", F.lit(0)))

    def last(status):
        return F.max(F.when(F.col("status") == status, F.col("id")))

    each = steps.groupBy("event_type", "table_name", "folder").agg(
        last("planned").alias("_planned"), last("success").alias("_done"), F.max("row_count").alias("row_count"))
    return each.filter(F.col("_planned") > F.coalesce("_done", F.lit(-1))).drop("_planned", "_done")


def reconcile(history: DataFrame, verified: DataFrame, full: bool = True) -> DataFrame:
    """Recorded against stored rows per (run, table).

    With `full`, runs that have no sound file left and stored runs that the history does
    not know are there too. A run without a sound file is `empty` if it archived no row,
    `expired` or `moved` if a lifecycle step took it, else `missing`; a stored run without a record is `unrecorded`.
    """
    joined = expected_rows(history).join(
        actual_rows(verified), ["run_id", "table_name"], "full_outer" if full else "inner"
    ).join(gone_runs(history), ["run_id", "table_name"], "left")
    status = (
        F.when(F.col("actual_rows").isNull() & (F.col("expected_rows") == 0), "empty")
        .when(F.col("actual_rows").isNull() & F.col("_gone").isNotNull(), F.col("_gone"))
        .when(F.col("actual_rows").isNull(), "missing")
        .when(F.col("expected_rows").isNull(), "unrecorded")
        .when(F.col("expected_rows") == F.col("actual_rows"), "match")
        .otherwise("mismatch")
    )
    none = F.lit(0).cast("bigint")
    return joined.select(
        "run_id", "table_name", F.coalesce("expected_rows", none).alias("expected_rows"),
        F.coalesce("actual_rows", none).alias("actual_rows"), status.alias("status"),
    )


def lifecycle_action(published_at: Column, policy: LifecyclePolicy, as_of: datetime) -> Column:
    """`keep`, `transition` or `expire` by age in whole days; expiry wins."""
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz").cast("timestamp")
    seconds = F.unix_micros(now) - F.unix_micros(published_at.cast("timestamp"))
    age = F.floor(seconds / F.lit(86_400_000_000))
    action = F.lit("keep")
    if policy.transition_days:
        action = F.when(age >= policy.transition_days, "transition").otherwise(action)
    if policy.expiration_days:
        action = F.when(age >= policy.expiration_days, "expire").otherwise(action)
    return action


def ageing(archives: DataFrame, policy: LifecyclePolicy, as_of: datetime) -> DataFrame:
    """Archives with the step that is due for them."""
    return archives.withColumn("action", lifecycle_action(F.col("published_at"), policy, as_of))
