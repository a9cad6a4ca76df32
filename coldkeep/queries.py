"""The registered queries: every operator and job over the given tables.

Each takes (spark, folder of Parquet tables) and returns a DataFrame. Jobs that write
work in a fresh folder of the shared workspace and return what they read back.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coldkeep.functions import canonical, names, numbers
from coldkeep.functions.digest import grouped_totals
from coldkeep.model import KeyAuditFailed, LifecyclePolicy, Rule, Selection, TableRule
from coldkeep.operators import batches, chunks, expire, intervals, keys, purge, reports, row_groups, verify
from coldkeep.operators.restore import conflicts_with_hot, key_counts
from coldkeep.plans import archive, lifecycle, restore
from coldkeep.plans.compaction import compact_rule
from coldkeep.plans.listing import list_files
from coldkeep.plans.verify import compare_with_archive, verify_against_history, verify_rule
from coldkeep.session import prepare, workspace
from coldkeep.sources.archive_store import ArchiveStore
from coldkeep.sources.history import HISTORY_SCHEMA, History
from coldkeep.sources.hot_table import HotTable, union_all
from coldkeep.streaming import verify_stream

BATCH = 1000
DAYS = 1095
ORDERS_AS_OF = datetime(2000, 1, 1)
ORDERS_CUTOFF = datetime(1997, 1, 1)
EVENTS_DAYS = 14
EVENTS_AS_OF = datetime(2024, 1, 31)
EVENTS_CUTOFF = datetime(2024, 1, 17)
# Cutoffs of three successive runs over orders.
STEPS = {"00000001": datetime(1995, 7, 1), "12e45678": datetime(1996, 1, 1), "c0ffee03": ORDERS_CUTOFF}

ORDERS = TableRule("orders", "o_orderdate", DAYS, ("o_orderkey",))
EVENTS = TableRule("events", "ts", EVENTS_DAYS, ("ts", "user_id"))
# No usable key: the pair repeats, so archiving this table must be refused.
LINEITEM = TableRule("lineitem", "l_shipdate", DAYS, ("l_orderkey", "l_linenumber"))


# Chunks of events as a database may list them: of any length, and not without gaps.
CHUNK_BOUNDS = [
    intervals.Interval("c1", datetime(2024, 1, 1), datetime(2024, 1, 4, 6)),
    intervals.Interval("c2", datetime(2024, 1, 5), datetime(2024, 1, 12)),
    intervals.Interval("c3", datetime(2024, 1, 12), EVENTS_CUTOFF),
    intervals.Interval("c4", EVENTS_CUTOFF, datetime(2024, 1, 25, 12, 30)),
    intervals.Interval("c5", datetime(2030, 1, 1), datetime(2031, 1, 1)),
]


def as_of_for(cutoff: datetime, days: int = DAYS) -> datetime:
    return cutoff + timedelta(days=days)


class Scene:
    """A database folder, an archive store and a history in a fresh working folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir
        self.root = workspace(spark, "scene")
        self.store = ArchiveStore(spark, f"{self.root}/archive")
        self.history = History(spark, f"{self.root}/history")

    def rows(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def adopt(self, table: str) -> HotTable:
        return HotTable.adopt(self.spark, f"{self.root}/hot/{table}", [f"{self.sf_dir}/{table}.parquet"])

    def load(self, name: str, df: DataFrame, table: TableRule, unit: str | None = None) -> HotTable:
        return HotTable.load(self.spark, f"{self.root}/hot/{name}", df, table.date_column, unit, table.key)

    def archive(self, rule: Rule, hot: dict[str, HotTable], as_of: datetime, run_id: str, **options) -> DataFrame:
        return archive.archive_rule(self.spark, rule, self.store, hot, as_of, run_id, self.history, **options)

    def orders_in_steps(self, **options) -> tuple[Rule, dict[str, HotTable]]:
        """Archive and purge orders in three runs with later and later cutoffs."""
        rule, hot = rule_of(ORDERS), {"orders": self.adopt("orders")}
        for run_id, cutoff in STEPS.items():
            self.archive(rule, hot, as_of_for(cutoff), run_id, **options)
        return rule, hot


# Jobs by name: what is set up, and the job itself with the result that is read. The bench times the job alone.
JOBS: dict[str, tuple] = {}


def job(prepare):
    """Registers the decorated function as the job that follows `prepare`, as a query."""
    def register(run):
        JOBS[run.__name__] = (prepare, run)

        def query(spark, sf_dir):
            scene = Scene(spark, sf_dir)
            return run(scene, prepare(scene))

        query.__name__, query.__doc__ = run.__name__, run.__doc__
        return query

    return register


def rule_of(*tables: TableRule, name: str = "keep-online", encoding: str = "native", batch: int = BATCH) -> Rule:
    return Rule(name, "shop", tables, batch, encoding)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# -- expiry ---------------------------------------------------------------------


def expired_rows(spark, sf_dir):
    return expire.expired(table(spark, sf_dir, "orders"), "o_orderdate", ORDERS_CUTOFF)


def expired_events(spark, sf_dir):
    return expire.expired(table(spark, sf_dir, "events"), "ts", EVENTS_CUTOFF)


def expired_keys(spark, sf_dir):
    return expire.expired_keys(table(spark, sf_dir, "events"), "ts", EVENTS_CUTOFF, EVENTS.key)


def expired_null_dates(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    undated = events.withColumn("ts", F.when(F.col("event_type") != "error", F.col("ts")))
    return expire.expired(undated, "ts", EVENTS_CUTOFF)


def kept_null_dates(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    undated = events.withColumn("ts", F.when(F.col("event_type") != "error", F.col("ts")))
    return expire.unexpired(undated, "ts", EVENTS_CUTOFF)


def retention_preview(spark, sf_dir):
    return expire.preview([
        (t.name, table(spark, sf_dir, t.name), t.date_column, cutoff)
        for t, cutoff in ((ORDERS, ORDERS_CUTOFF), (LINEITEM, ORDERS_CUTOFF), (EVENTS, EVENTS_CUTOFF))
    ])


def preview_from_footers(spark, sf_dir):
    """The dry run of tables on files."""
    scene = Scene(spark, sf_dir)
    rules = [(Rule("keep-online", "shop", (t,), 1000), as_of) for t, as_of in (
        (ORDERS, ORDERS_AS_OF), (LINEITEM, ORDERS_AS_OF), (EVENTS, EVENTS_AS_OF))]
    return union_all([
        archive.preview_rules([rule], {t.name: scene.adopt(t.name) for t in rule.tables}, as_of).select("table_name", "expired_rows", "cutoff")
        for rule, as_of in rules])


# -- keys and batches -------------------------------------------------------------


def batch_plan(spark, sf_dir):
    return batches.batch_plan(spark, expired_rows(spark, sf_dir), ORDERS.key, BATCH)


def batch_plan_composite(spark, sf_dir):
    return batches.batch_plan(spark, expired_events(spark, sf_dir), EVENTS.key, BATCH)


def key_audit(spark, sf_dir):
    return keys.duplicate_keys(table(spark, sf_dir, "lineitem"), LINEITEM.key)


def key_report(spark, sf_dir):
    audited = {"orders": ORDERS.key, "events": EVENTS.key, "lineitem": LINEITEM.key, "conversations": ("conv_id", "turn")}
    return union_all([
        keys.key_report(table(spark, sf_dir, name), key).withColumn("table_name", F.lit(name))
        for name, key in audited.items()
    ])


# -- purging by key and by chunk --------------------------------------------------


def _archived(rule_table: TableRule, as_of: datetime):
    """A table in one piece with an archived run that is not purged."""
    def prepare(scene: Scene) -> tuple[Rule, dict[str, HotTable]]:
        rule, hot = rule_of(rule_table, batch=100_000), {rule_table.name: scene.adopt(rule_table.name)}
        scene.archive(rule, hot, as_of, "0000aaaa", purge=False)
        return rule, hot

    return prepare


@job(_archived(ORDERS, ORDERS_AS_OF))
def purge_single_key(scene, made):
    rule, hot = made
    archive.purge_run(scene.store, rule, hot, ORDERS_AS_OF, "0000aaaa")
    return hot["orders"].df()


@job(_archived(EVENTS, EVENTS_AS_OF))
def purge_composite_key(scene, made):
    rule, hot = made
    archive.purge_run(scene.store, rule, hot, EVENTS_AS_OF, "0000aaaa")
    return hot["events"].df()


def purge_hits(spark, sf_dir):
    """Rows a purge of lineitem by its non-unique pair would hit, expired or not."""
    items = table(spark, sf_dir, "lineitem")
    expired_pairs = expire.expired_keys(items, "l_shipdate", ORDERS_CUTOFF, LINEITEM.key)
    hit = purge.purged_by_key(items, purge.distinct_keys(spark, expired_pairs, LINEITEM.key), LINEITEM.key)
    wrong = F.count_if(~expire.is_expired(items, "l_shipdate", ORDERS_CUTOFF))
    return hit.agg(F.count(F.lit(1)).alias("rows_hit"), wrong.alias("unexpired_rows_hit"))


def chunk_inventory(spark, sf_dir):
    return chunks.chunk_inventory(table(spark, sf_dir, "events"), "ts", "week", EVENTS_CUTOFF)


def _chunked_events(scene: Scene) -> dict[str, HotTable]:
    return {"events": scene.load("events", scene.rows("events"), EVENTS, "week")}


def _archived_events(scene: Scene) -> dict[str, HotTable]:
    hot = _chunked_events(scene)
    scene.archive(rule_of(EVENTS), hot, EVENTS_AS_OF, "0000aaaa", purge=False)
    return hot


@job(_archived_events)
def chunk_purge(scene, hot):
    run = scene.store.runs("shop", "events")[0]
    archive.drop_archived_chunks(scene.store, run, rule_of(EVENTS), EVENTS, hot["events"], EVENTS_CUTOFF)
    return hot["events"].df()


def purge_chunked_table(spark, sf_dir):
    scene = Scene(spark, sf_dir)
    hot = _chunked_events(scene)
    scene.archive(rule_of(EVENTS), hot, EVENTS_AS_OF, "0000aaaa")
    return hot["events"].df()


def purge_accounting(spark, sf_dir):
    scene = Scene(spark, sf_dir)
    summary = scene.archive(rule_of(EVENTS), _chunked_events(scene), EVENTS_AS_OF, "0000aaaa")
    return summary.select("rows_archived", "chunks_dropped", "chunk_deleted", "key_deleted", "rows_remaining", "mismatch")


def purge_spares_late_rows(spark, sf_dir):
    """Expired rows that arrive between archive and purge stay in the hot table."""
    scene = Scene(spark, sf_dir)
    hot = _chunked_events(scene)
    scene.archive(rule_of(EVENTS), hot, EVENTS_AS_OF, "0000aaaa", purge=False)
    late = scene.rows("events").filter(F.col("event_type") == "error").withColumn("user_id", -F.col("user_id") - 1)
    hot["events"].append(expire.expired(late, "ts", EVENTS_CUTOFF), EVENTS.key)
    archive.purge_run(scene.store, rule_of(EVENTS), hot, EVENTS_AS_OF, "0000aaaa")
    return hot["events"].df()


def purge_repeated_key(spark, sf_dir):
    """Rows with an archived key but other content, added before the purge, stay in the hot table."""
    scene = Scene(spark, sf_dir)
    hot = _chunked_events(scene)
    scene.archive(rule_of(EVENTS), hot, EVENTS_AS_OF, "0000aaaa", purge=False)
    changed = scene.rows("events").filter(F.col("event_type") == "error").withColumn("value", F.col("value") + 1)
    hot["events"].append(expire.expired(changed, "ts", EVENTS_CUTOFF), EVENTS.key)
    archive.purge_run(scene.store, rule_of(EVENTS), hot, EVENTS_AS_OF, "0000aaaa")
    return hot["events"].df()


def _chunk_folders(scene: Scene, df: DataFrame, unit: str, name: str) -> str:
    """Rows as plain folders named by chunk, as another writer leaves them."""
    folder = f"{scene.root}/raw/{name}"
    df.withColumn("chunk_start", chunks.chunk_name("ts", unit)).write.mode("append").partitionBy("chunk_start").parquet(folder)
    return folder


def purge_odd_weeks(spark, sf_dir):
    """Adopted weekly folders that begin on Thursdays: dropped by their own bounds, and accounted for."""
    scene = Scene(spark, sf_dir)
    folder = _chunk_folders(scene, scene.rows("events"), "week+3", "events")
    hot = {"events": HotTable.adopt_chunks(scene.spark, f"{scene.root}/hot/events", folder, "ts", "week")}
    return scene.archive(rule_of(EVENTS), hot, EVENTS_AS_OF, "0000aaaa").select(
        "rows_archived", "chunks_dropped", "chunk_deleted", "key_deleted", "rows_remaining", "mismatch")


def adopt_schema_drift(spark, sf_dir):
    """Weekly folders of which the later ones have one more column: archived and kept rows carry it."""
    scene = Scene(spark, sf_dir)
    events, step = scene.rows("events"), datetime(2024, 1, 8)
    _chunk_folders(scene, expire.expired(events, "ts", step), "week", "events")
    later = expire.unexpired(events, "ts", step).withColumn("kind", F.upper("event_type"))
    folder = _chunk_folders(scene, later, "week", "events")
    hot = {"events": HotTable.adopt_chunks(scene.spark, f"{scene.root}/hot/events", folder, "ts", "week")}
    scene.archive(rule_of(EVENTS), hot, EVENTS_AS_OF, "0000aaaa")
    schema = hot["events"].schema()
    archived = restore.archived_rows(scene.store, scene.store.runs("shop", "events"), schema).select(*schema.fieldNames())
    return union_all([archived.withColumn("tier", F.lit("archive")), hot["events"].df().withColumn("tier", F.lit("hot"))])


# -- archiving --------------------------------------------------------------------


def _read_archive(scene: Scene, name: str, selection: Selection = Selection()) -> DataFrame:
    schema = scene.rows(name).schema
    rows = restore.archived_rows(scene.store, scene.store.runs("shop", name, selection, required=True), schema)
    return rows.select(*schema.fieldNames())


@job(lambda scene: {"orders": scene.adopt("orders")})
def archive_roundtrip(scene, hot):
    scene.archive(rule_of(ORDERS), hot, ORDERS_AS_OF, "12e45678")
    return _read_archive(scene, "orders")


def archive_publish(spark, sf_dir):
    """Rows a reader sees while a run is staged and after it is published."""
    scene = Scene(spark, sf_dir)
    staged = archive.stage_table(scene.store, rule_of(ORDERS), ORDERS, scene.adopt("orders"), ORDERS_AS_OF, "12e45678")
    before = len(scene.store.runs("shop", "orders"))
    pending = len(scene.store.pending_runs())
    scene.store.publish([staged.run])
    return (
        _read_archive(scene, "orders").agg(F.count(F.lit(1)).alias("rows_published"))
        .select(
            F.lit(before).cast("bigint").alias("runs_visible_while_staged"),
            F.lit(pending).cast("bigint").alias("pending_while_staged"),
            F.lit(len(scene.store.pending_runs())).cast("bigint").alias("pending_after"),
            "rows_published",
        )
    )


def archive_abort(spark, sf_dir):
    """A failing table drops the whole run and leaves every hot table as it was."""
    scene = Scene(spark, sf_dir)
    hot = {"orders": scene.adopt("orders"), "lineitem": scene.adopt("lineitem")}
    try:
        scene.archive(rule_of(ORDERS, LINEITEM), hot, ORDERS_AS_OF, "12e45678")
    except KeyAuditFailed:
        pass
    events = scene.history.df().groupBy("table_name").agg(F.count_if(F.col("status") == "error").alias("errors"))
    rows = union_all([
        hot[name].df().agg(F.count(F.lit(1)).alias("hot_rows")).withColumn("table_name", F.lit(name)) for name in hot
    ])
    return rows.join(events, "table_name", "left").select(
        "table_name", "hot_rows", F.coalesce("errors", F.lit(0)).cast("bigint").alias("error_events"),
        F.lit(len(scene.store.pending_runs())).cast("bigint").alias("pending_runs"),
        F.lit(len(scene.store.runs("shop", "orders"))).cast("bigint").alias("published_runs"),
    )


def archive_idempotent(spark, sf_dir):
    scene = Scene(spark, sf_dir)
    hot = {"orders": scene.adopt("orders")}
    return union_all([
        scene.archive(rule_of(ORDERS), hot, ORDERS_AS_OF, run_id).select("run_id", "rows_archived", "rows_remaining")
        for run_id in ("00000001", "00000002")
    ])


def archive_manifest(spark, sf_dir):
    scene = Scene(spark, sf_dir)
    scene.archive(rule_of(ORDERS), {"orders": scene.adopt("orders")}, ORDERS_AS_OF, "12e45678", order="exact")
    manifest = scene.store.manifest(scene.store.runs("shop", "orders"))
    return manifest.groupBy("cutoff_date", "run_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("rows").cast("bigint").alias("rows"), F.max("rows").alias("largest_file")
    )


def archive_listing(spark, sf_dir):
    """Stored files per run, from the file listing, next to the recorded rows."""
    scene = Scene(spark, sf_dir)
    scene.orders_in_steps(order="exact")
    runs = scene.store.runs("shop", "orders")
    listed = list_files(scene.store, runs).groupBy("cutoff_date", "run_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if((F.col("length") > 0) & F.col("modified_at").isNotNull()).alias("sized_and_dated"),
    )
    recorded = scene.store.manifest(runs).groupBy("run_id").agg(F.sum("rows").cast("bigint").alias("rows"))
    return listed.join(recorded, "run_id").select("cutoff_date", "run_id", "files", "sized_and_dated", "rows")


def archive_late_rows(spark, sf_dir):
    """Rows that arrive older than a past cutoff are taken by the next run."""
    scene = Scene(spark, sf_dir)
    step, orders = STEPS["12e45678"], scene.rows("orders")
    is_late = F.col("o_orderpriority") == "1-URGENT"
    rule, hot = rule_of(ORDERS), {"orders": scene.load("orders", orders.filter(~is_late), ORDERS)}
    scene.archive(rule, hot, as_of_for(step), "00000001")
    hot["orders"].append(orders.filter(is_late))
    scene.archive(rule, hot, ORDERS_AS_OF, "00000002")
    return _read_archive(scene, "orders", Selection(run_id="00000002"))


def archive_select(spark, sf_dir):
    scene = Scene(spark, sf_dir)
    scene.orders_in_steps()
    return _read_archive(scene, "orders", Selection(cutoff_date="1996-01-01", run_id="12e45678"))


_SUMMARY = ["rule", "table_name", "rows_archived", "chunk_deleted", "key_deleted", "rows_remaining", "mismatch"]


@job(lambda scene: {"orders": scene.adopt("orders"), **_chunked_events(scene)})
def archive_rule(scene, hot):
    # One as-of for both tables, so orders stays online longer.
    orders = TableRule("orders", "o_orderdate", (EVENTS_AS_OF - ORDERS_CUTOFF).days, ORDERS.key)
    return scene.archive(rule_of(orders, EVENTS), hot, EVENTS_AS_OF, "0000aaaa").select(*_SUMMARY)


def archive_all_rules(spark, sf_dir):
    """Two sound rules and two failing ones, one of a table that is not there; the failures do not stop the others."""
    scene = Scene(spark, sf_dir)
    days = (EVENTS_AS_OF - ORDERS_CUTOFF).days
    rules = [
        rule_of(TableRule("orders", "o_orderdate", days, ORDERS.key), name="orders"),
        rule_of(TableRule("lineitem", "l_shipdate", days, LINEITEM.key), name="lineitem"),
        rule_of(TableRule("returns", "r_date", days, ("r_key",)), name="returns"),
        rule_of(EVENTS, name="events"),
    ]
    hot = {name: scene.adopt(name) for name in ("orders", "lineitem", "events")}
    runs = {"orders": "00000001", "lineitem": "00000002", "returns": "00000003", "events": "00000004"}
    told = archive.archive_all_rules(spark, rules, scene.store, hot, EVENTS_AS_OF, runs, scene.history, keep_going=True, count_failed=True)
    # not known of a table that is not there
    return told.select(*_SUMMARY, "status").withColumn("rows_remaining", F.coalesce("rows_remaining", F.lit(-1)))


def run_summary(spark, sf_dir):
    """Totals per run of three successive runs."""
    scene = Scene(spark, sf_dir)
    rule, hot = rule_of(ORDERS), {"orders": scene.adopt("orders")}
    tables = [scene.archive(rule, hot, as_of_for(cutoff), run_id, order="exact") for run_id, cutoff in STEPS.items()]
    deleted = F.col("chunk_deleted") + F.col("key_deleted")
    return union_all(tables).groupBy("run_id").agg(
        F.sum("rows_archived").cast("bigint").alias("rows_archived"),
        F.sum(deleted).cast("bigint").alias("rows_deleted"),
        F.sum("files").cast("bigint").alias("files"),
    )


# -- restoring --------------------------------------------------------------------


@job(Scene.orders_in_steps)
def restore_append(scene, made):
    rule, hot = made
    restore.restore_rule(scene.spark, rule, scene.store, hot, ORDERS_AS_OF, history=scene.history)
    return hot["orders"].df()


def restore_one_run(spark, sf_dir):
    scene = Scene(spark, sf_dir)
    rule, hot = scene.orders_in_steps()
    restore.restore_rule(spark, rule, scene.store, hot, ORDERS_AS_OF, Selection(run_id="12e45678"), scene.history)
    return hot["orders"].df()


def restore_chunked_table(spark, sf_dir):
    scene = Scene(spark, sf_dir)
    hot = _chunked_events(scene)
    scene.archive(rule_of(EVENTS), hot, EVENTS_AS_OF, "0000aaaa")
    restore.restore_rule(spark, rule_of(EVENTS), scene.store, hot, EVENTS_AS_OF)
    return hot["events"].df()


def restore_preview(spark, sf_dir):
    scene = Scene(spark, sf_dir)
    rule, _ = scene.orders_in_steps(order="exact")
    return restore.preview_restore(scene.store, rule)


def restore_preview_lost(spark, sf_dir):
    """The first file of each run is gone; the dry run counts what is left."""
    scene = Scene(spark, sf_dir)
    rule, _ = scene.orders_in_steps(order="exact")
    runs = scene.store.runs("shop", "orders")
    first = {r["run_id"]: r["file_name"] for r in scene.store.batches(runs).filter(F.col("batch") == 0).collect()}
    for run in runs:
        scene.store.files.delete(f"{scene.store.run_path(run)}/{first[run.run_id]}")
    return restore.preview_restore(scene.store, rule)


def _half_restored(scene: Scene) -> tuple[Rule, dict[str, HotTable]]:
    """Everything before the cutoff archived and purged, then the oldest rows put back."""
    rule, hot = rule_of(ORDERS), {"orders": scene.adopt("orders")}
    scene.archive(rule, hot, ORDERS_AS_OF, "c0ffee03")
    hot["orders"].append(expire.expired(scene.rows("orders"), "o_orderdate", STEPS["12e45678"]))
    return rule, hot


def restore_conflicts(spark, sf_dir):
    scene = Scene(spark, sf_dir)
    _, hot = _half_restored(scene)
    counts = key_counts(spark, _read_archive(scene, "orders"), ORDERS.key)
    return conflicts_with_hot(counts, hot["orders"].df(), ORDERS.key)


def restore_skip_existing(spark, sf_dir):
    scene = Scene(spark, sf_dir)
    rule, hot = _half_restored(scene)
    restore.restore_rule(spark, rule, scene.store, hot, ORDERS_AS_OF, on_conflict="skip")
    return hot["orders"].df()


def restore_schema_drift(spark, sf_dir):
    """The older run has no priority column and a narrower customer key."""
    scene = Scene(spark, sf_dir)
    rule, orders, step = rule_of(ORDERS), scene.rows("orders"), STEPS["12e45678"]
    old = orders.drop("o_orderpriority").withColumn("o_custkey", F.col("o_custkey").cast("int"))
    scene.archive(rule, {"orders": scene.load("orders-old", old, ORDERS)}, as_of_for(step), "00000001")
    hot = {"orders": scene.load("orders", expire.unexpired(orders, "o_orderdate", step), ORDERS)}
    scene.archive(rule, hot, ORDERS_AS_OF, "00000002")
    restore.restore_rule(spark, rule, scene.store, hot, ORDERS_AS_OF)
    return hot["orders"].df()


def restore_canonical(spark, sf_dir):
    """Archive in the six-type encoding and restore to the native types."""
    scene = Scene(spark, sf_dir)
    rule, hot = rule_of(EVENTS, encoding="canonical"), {"events": scene.adopt("events")}
    scene.archive(rule, hot, EVENTS_AS_OF, "0000aaaa")
    restore.restore_rule(spark, rule, scene.store, hot, EVENTS_AS_OF)
    return hot["events"].df()


# -- verifying and reconciling ----------------------------------------------------


def _damaged(scene: Scene) -> Rule:
    """Three runs; the first file is replaced by text in one, emptied in another, lost in the third."""
    rule, _ = scene.orders_in_steps(order="exact")
    runs = scene.store.runs("shop", "orders")
    first = {
        r["run_id"]: r["file_name"] for r in scene.store.batches(runs).filter(F.col("batch") == 0).collect()
    }
    for run, damage in zip(runs, ("text", "empty", "lost")):
        path = f"{scene.store.run_path(run)}/{first[run.run_id]}"
        if damage == "lost":
            scene.store.files.delete(path)
        else:
            text = "this is not a parquet file" if damage == "text" else ""
            scene.store.files.write_text(path, text, overwrite=True)
    return rule


@job(_damaged)
def verify_archive(scene, rule):
    """Status of every file, with the batch number its manifest gives it."""
    batch = scene.store.batches(scene.store.runs("shop", "orders")).select("run_id", "file_name", "batch")
    verified = verify_rule(scene.spark, rule, scene.store)
    return verified.join(batch, ["run_id", "file_name"], "left").select("run_id", "batch", "status", "rows")


def verify_unrecorded(spark, sf_dir):
    """Runs of another writer, without manifests: sound, without rows, and damaged."""
    scene = Scene(spark, sf_dir)
    orders, base = expired_rows(spark, sf_dir), scene.store.table_path("shop", "orders")
    for run_id, rows in (("aaaa0001", orders), ("aaaa0002", orders.limit(0)), ("aaaa0003", orders)):
        rows.coalesce(1).write.parquet(f"{base}/cutoff_date=1997-01-01/run_id={run_id}")
    scene.store.files.write_text(f"{base}/cutoff_date=1997-01-01/run_id=aaaa0003/x.parquet", "PAR1 not parquet PAR1")
    return verify_rule(spark, rule_of(ORDERS), scene.store).select("run_id", "status", "rows")


def verify_totals(spark, sf_dir):
    scene = Scene(spark, sf_dir)
    return verify.totals(verify_rule(spark, _damaged(scene), scene.store))


def incremental_verify(spark, sf_dir):
    """Three runs published between passes of the stream; each is judged once."""
    scene = Scene(spark, sf_dir)
    rule, hot = rule_of(ORDERS), {"orders": scene.adopt("orders")}
    for run_id, cutoff in STEPS.items():
        scene.archive(rule, hot, as_of_for(cutoff), run_id)
        verify_stream.verify_new_runs(
            spark, scene.store, "shop", "orders", f"{scene.root}/verified", f"{scene.root}/verified-checkpoint"
        )
    return verify_stream.verified(spark, f"{scene.root}/verified").groupBy("run_id").agg(
        F.min(F.col("batch_id").cast("bigint")).alias("pass"),
        F.count_if(F.col("status") != "OK").alias("bad_files"),
        F.sum("rows").cast("bigint").alias("rows"),
    )


def _misrecorded(scene: Scene) -> tuple[Rule, DataFrame]:
    """Three runs; the record of the second is one too high and the files of the third are gone."""
    rule, _ = scene.orders_in_steps()
    last = scene.store.runs("shop", "orders", Selection(run_id="c0ffee03"))[0]
    scene.store.files.delete(scene.store.run_path(last))
    recorded = scene.history.df().withColumn(
        "row_count", F.col("row_count") + F.when(F.col("run_id") == "12e45678", 1).otherwise(0)
    )
    return rule, recorded


@job(_misrecorded)
def history_reconcile(scene, made):
    return verify_against_history(scene.spark, made[0], scene.store, made[1], full=False)


@job(_misrecorded)
def history_reconcile_full(scene, made):
    return verify_against_history(scene.spark, made[0], scene.store, made[1], full=True)


def reconcile_empty_run(spark, sf_dir):
    """A second run that found nothing to archive is not missing."""
    scene = Scene(spark, sf_dir)
    rule, hot = rule_of(ORDERS), {"orders": scene.adopt("orders")}
    for run_id in ("00000001", "00000002"):
        scene.archive(rule, hot, ORDERS_AS_OF, run_id)
    return verify_against_history(spark, rule, scene.store, scene.history.df())


def reconcile_after_lifecycle(spark, sf_dir):
    """Of three runs one expired, one moved and one was lost, so none is left here."""
    scene = Scene(spark, sf_dir)
    rule, _ = scene.orders_in_steps()
    first, second, third = (as_of_for(c) for c in STEPS.values())
    lifecycle.delete_expired(scene.store, rule, LifecyclePolicy(0, 100), first + timedelta(days=100), scene.history)
    cold = ArchiveStore(spark, f"{scene.root}/cold")
    lifecycle.move_to_cold(scene.store, cold, rule, LifecyclePolicy(100, 0), second + timedelta(days=100), scene.history)
    scene.store.delete(scene.store.runs("shop", "orders", Selection(run_id="c0ffee03"))[0])
    return verify_against_history(spark, rule, scene.store, scene.history.df())


# -- history ----------------------------------------------------------------------


def history_append(spark, sf_dir):
    """Events left by two archive runs, a refused one and a restore."""
    scene = Scene(spark, sf_dir)
    rule = rule_of(ORDERS)
    hot = {name: scene.adopt(name) for name in ("orders", "lineitem")}
    scene.archive(rule, hot, as_of_for(STEPS["12e45678"]), "00000001")
    scene.archive(rule, hot, ORDERS_AS_OF, "00000002")
    try:
        scene.archive(rule_of(LINEITEM), hot, ORDERS_AS_OF, "00000003")
    except KeyAuditFailed:
        pass
    restore.restore_rule(spark, rule, scene.store, hot, ORDERS_AS_OF, Selection(run_id="00000002"), scene.history)
    # Ids only rise; their rank is the same in every run.
    ranked = scene.history.df().withColumn("id", F.row_number().over(Window.orderBy("id")).cast("bigint"))
    return reports.files_as_json(ranked).select(
        "id", "run_id", "rule", "event_type", "table_name", "row_count", "files", "status",
        (F.length("error_message") > 0).alias("has_error_message"),
    )


def history_files(spark, sf_dir):
    """File lists to JSON text and back."""
    events = _events_as_history(spark, sf_dir).withColumn(
        "files", F.filter(F.array("rule", "run_id", F.lit(None)), lambda f: F.coalesce(f != "error", F.lit(False))))
    back = reports.files_from_json(reports.files_as_json(events))
    return back.select("id", F.size("files").cast("bigint").alias("n_files"), F.array_join("files", "|").alias("joined"))


def _events_as_history(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("id"),
        F.lpad(F.lower(F.hex("user_id")), 8, "0").alias("run_id"),
        F.col("event_type").alias("rule"),
        F.lit("archive").alias("event_type"),
        F.lit("events").alias("table_name"),
        F.col("user_id").alias("row_count"),
        F.array().cast("array<string>").alias("files"),
        F.lit("success").alias("status"),
        F.lit("").alias("error_message"),
        F.col("ts").alias("start_time"),
        (F.col("ts") + F.make_dt_interval(secs=F.abs(F.col("value")).cast("decimal(18,6)"))).alias("end_time"),
    ).select(*HISTORY_SCHEMA.fieldNames())


def history_recent(spark, sf_dir):
    return reports.recent(_events_as_history(spark, sf_dir), rule="error").select("id", "run_id", "rule", "start_time")


def history_durations(spark, sf_dir):
    """Each user's span of events as a run, with its duration."""
    events = table(spark, sf_dir, "events")
    runs = events.groupBy("user_id").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
    return reports.with_duration(runs)


# -- encoding, names and numbers --------------------------------------------------


def canonical_encode(spark, sf_dir):
    return canonical.encode(table(spark, sf_dir, "events"))


def canonical_decode(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return canonical.decode(canonical.encode(events), events.schema)


def canonical_bool(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return canonical.encode(events.select("event_id", (F.col("event_type") == "error").alias("is_error"), F.col("value").cast("float").alias("value")))


def canonical_nested(spark, sf_dir):
    """Microseconds inside a nested value survive the encoding."""
    nested = table(spark, sf_dir, "events").select("event_id", F.struct("ts", "user_id", F.array("ts").alias("all")).alias("at"))
    back = canonical.decode(canonical.encode(nested), nested.schema)
    return back.select("event_id", "at.ts", "at.user_id", F.col("at.all")[0].alias("again"))


def canonical_by_db_type(spark, sf_dir):
    """Orders encoded by declared database types; the table lacks one declared column."""
    declared = {
        "o_orderkey": "bigserial", "o_custkey": "int4", "o_orderstatus": "varchar", "o_totalprice": "double precision",
        "o_orderdate": "timestamp without time zone", "o_comment": "text",
    }
    return canonical.encode_as(table(spark, sf_dir, "orders"), declared)


def canonical_narrowing(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey",
        numbers.wrap_int32(F.col("o_orderkey") * 1_000_003).alias("wrapped"),
        numbers.truncate_to_int64(-F.col("o_totalprice")).alias("truncated"),
    )


def sanitize_identifiers(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.sanitized(F.col("url")).alias("name"))


def parse_archive_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    keyed = orders.select("o_orderkey", names.archive_key(
        F.lit("shop.db"), F.lit("order lines"), F.col("o_orderdate"),
        F.lpad(F.lower(F.hex("o_orderkey")), 8, "0"), F.col("o_custkey"),
    ).alias("archive_key"))
    key = F.col("archive_key")
    return keyed.select(
        "o_orderkey", "archive_key", names.key_file_name(key).alias("file_name"), names.key_run_id(key).alias("run_id"),
        names.key_mentions(key, F.lit("-07-")).alias("mentions_july"),
    )


def format_counts(spark, sf_dir):
    n = F.floor("o_totalprice").cast("bigint")
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.format_count(n * F.col("o_custkey")).alias("count_text"))


# -- lifecycle --------------------------------------------------------------------


def archive_lifecycle(spark, sf_dir):
    """One archive per order date, published on that date: files and rows per due action."""
    orders = table(spark, sf_dir, "orders")
    archives = orders.groupBy(F.col("o_orderdate").alias("published_at")).agg(F.count(F.lit(1)).alias("rows"))
    due = reports.ageing(archives, LifecyclePolicy(30, 1460), ORDERS_AS_OF)
    return due.groupBy("action").agg(F.count(F.lit(1)).alias("archives"), F.sum("rows").cast("bigint").alias("rows"))


def lifecycle_delete(spark, sf_dir):
    """Runs published at successive times; the ones due are deleted, the rest stay readable."""
    scene = Scene(spark, sf_dir)
    rule, _ = scene.orders_in_steps()
    now = as_of_for(STEPS["12e45678"]) + timedelta(days=100)
    lifecycle.delete_expired(scene.store, rule, LifecyclePolicy(30, 100), now)
    return _read_archive(scene, "orders")


def lifecycle_move(spark, sf_dir):
    """Runs due for colder storage are moved there; every archived row is in one of the two."""
    scene = Scene(spark, sf_dir)
    rule, _ = scene.orders_in_steps()
    cold = ArchiveStore(spark, f"{scene.root}/cold")
    now = as_of_for(STEPS["12e45678"]) + timedelta(days=100)
    lifecycle.move_to_cold(scene.store, cold, rule, LifecyclePolicy(30, 0), now)
    schema = scene.rows("orders").schema
    return union_all([
        restore.archived_rows(store, store.runs("shop", "orders"), schema)
        .select(*schema.fieldNames(), F.lit(tier).alias("tier"))
        for tier, store in (("archive", scene.store), ("cold", cold))
    ])


def lifecycle_resume(spark, sf_dir):
    """A deletion that stopped after the rows and a copy that died while writing are finished by a repeat."""
    scene = Scene(spark, sf_dir)
    rule, _ = scene.orders_in_steps()
    runs = {r.run_id: r for r in scene.store.runs("shop", "orders")}
    cold = ArchiveStore(spark, f"{scene.root}/cold")
    scene.store.files.delete(scene.store.run_path(runs["00000001"]))
    cold.open_run("12e45678")
    first, second = as_of_for(STEPS["00000001"]), as_of_for(STEPS["12e45678"])
    lifecycle.delete_expired(scene.store, rule, LifecyclePolicy(0, 100), first + timedelta(days=100))
    lifecycle.move_to_cold(scene.store, cold, rule, LifecyclePolicy(100, 0), second + timedelta(days=100))
    return union_all([
        store.manifest(store.runs("shop", "orders")).groupBy("run_id").agg(F.sum("rows").cast("bigint").alias("rows"))
        .withColumn("tier", F.lit(tier)) for tier, store in (("archive", scene.store), ("cold", cold))
    ])


def lifecycle_foreign_run(spark, sf_dir):
    """A run of another writer is recorded when archives are aged, and ages like any other."""
    scene = Scene(spark, sf_dir)
    rule, _ = scene.orders_in_steps()
    base = scene.store.table_path("shop", "orders")
    expire.unexpired(scene.rows("orders"), "o_orderdate", ORDERS_CUTOFF).write.parquet(f"{base}/cutoff_date=2001-01-01/run_id=f0e1d2c3")
    report = lifecycle.ageing_report(scene.store, rule, LifecyclePolicy(0, 36_500), datetime(2100, 1, 1))
    return report.select("run_id", "rows", "action")


def lifecycle_partial_failure(spark, sf_dir):
    """All three runs are due for deletion: the first goes, the second fails after its rows are gone, and the
    mark of the third is lost. The reconciliation before and after the job is repeated."""
    scene = Scene(spark, sf_dir)
    rule, _ = scene.orders_in_steps()
    policy, now = LifecyclePolicy(0, 100), ORDERS_AS_OF + timedelta(days=100)

    class Halting(ArchiveStore):
        def delete(self, run):
            if run.run_id == "12e45678":
                self.files.delete(self.run_path(run))
                raise OSError("the connection was lost")
            super().delete(run)

    class Forgetful(History):
        def record(self, events):
            super().record([e for e in events if (e.run_id, e.status) != ("c0ffee03", "success")])

    try:
        lifecycle.delete_expired(Halting(spark, scene.store.root), rule, policy, now, Forgetful(spark, scene.history.path))
    except OSError:
        pass
    before = verify_against_history(spark, rule, scene.store, scene.history.df()).withColumn("seen", F.lit("before"))
    lifecycle.delete_expired(scene.store, rule, policy, now, scene.history)
    after = verify_against_history(spark, rule, scene.store, scene.history.df()).withColumn("seen", F.lit("after"))
    return union_all([before, after])


def ageing_unreadable_run(spark, sf_dir):
    """A foreign run of which no file can be read has no age; the report names it, and all others age."""
    scene = Scene(spark, sf_dir)
    rule, _ = scene.orders_in_steps()
    base = scene.store.table_path("shop", "orders")
    expire.unexpired(scene.rows("orders"), "o_orderdate", ORDERS_CUTOFF).write.parquet(f"{base}/cutoff_date=2001-01-01/run_id=f0e1d2c3")
    scene.store.files.write_text(f"{base}/cutoff_date=2001-01-02/run_id=badbadba/part-0.parquet", "PAR1 no rows PAR1")
    report = lifecycle.ageing_report(scene.store, rule, LifecyclePolicy(0, 36_500), datetime(2100, 1, 1))
    unwritten = [r for r in scene.store.runs("shop", "orders") if r not in scene.store.recorded(scene.store.runs("shop", "orders"))]
    return report.select("run_id", "rows", "action", F.lit(len(unwritten)).cast("bigint").alias("unrecorded_runs"))


def history_segments(spark, sf_dir):
    """The newest error events of a history whose segments, one per day of events, are merged by weeks or so."""
    scene = Scene(spark, sf_dir)
    events = _events_as_history(spark, sf_dir).withColumn("_day", F.to_date("start_time"))
    days = [r[0] for r in events.select("_day").distinct().collect()]
    for day in days:
        scene.history.adopt(events.filter(F.col("_day") == F.lit(day)).drop("_day"))
    largest = max(s.events for s in scene.history.segments())
    scene.history.merge(7 * largest)
    newest = scene.history.recent("error")
    return newest.select("id", "run_id", "rule", "start_time", F.lit(len(scene.history.segments()) < len(days)).alias("merged"))


# -- to the row, to the row group, and chunks with any bounds -----------------------


def reconcile_rows(spark, sf_dir):
    """A restored table of as many rows as were archived, of which some were lost, changed or made up."""
    scene = Scene(spark, sf_dir)
    rule, hot = rule_of(ORDERS), {"orders": scene.adopt("orders")}
    scene.archive(rule, hot, ORDERS_AS_OF, "0000aaaa")
    key = F.col("o_orderkey")
    restored = _read_archive(scene, "orders").withColumn(
        "o_totalprice", F.when(key % 89 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).withColumn(
        "o_orderkey", F.when(key % 97 == 0, -key - 1).otherwise(key))
    table = scene.load("orders-restored", restored.unionByName(hot["orders"].df()), ORDERS)
    return compare_with_archive(spark, rule, "orders", scene.store, table, ORDERS_AS_OF)


def verify_row_groups(spark, sf_dir):
    """One bit is flipped in the last row group of one run: how many groups are damaged, and what a second pass reads."""
    scene = Scene(spark, sf_dir)
    scene.store = ArchiveStore(spark, scene.store.root, write_options={"parquet.block.size": "8192"})
    scene.orders_in_steps()
    store, runs = scene.store, scene.store.runs("shop", "orders")
    row_groups.record_row_groups(store, runs)
    late = row_groups.recorded_row_groups(store, runs).filter("run_id = '12e45678' and row_group >= 0").orderBy(
        F.desc("row_group"), "file_name").first()
    path = f"{store.run_path(runs[1])}/{late['file_name']}"
    data = bytearray(store.files.read_bytes(path))
    data[late["first_byte"] + late["n_bytes"] // 2] ^= 1
    store.files.write_bytes(path, data)
    first = row_groups.verify_row_groups(store, runs)
    again = row_groups.verify_row_groups(store, runs, known=first).groupBy("run_id").agg(F.count_if("read").alias("read_again"))
    bad = F.col("status") != "OK"
    hit = bad & (F.col("file_name") == late["file_name"]) & (F.col("row_group") == late["row_group"])
    return first.groupBy("run_id").agg(
        F.count_if(bad).alias("damaged_groups"), F.count_if(hit).alias("planted_groups"), F.sum("rows").cast("bigint").alias("rows"),
    ).join(again, "run_id")


def archive_compaction(spark, sf_dir):
    """Three runs in batches of 50, brought together: files per run, and whether its rows and digest are what they were."""
    scene = Scene(spark, sf_dir)
    rule, hot = rule_of(ORDERS, batch=50), {"orders": scene.adopt("orders")}
    for run_id, cutoff in STEPS.items():
        scene.archive(rule, hot, as_of_for(cutoff), run_id)
    store, runs = scene.store, scene.store.runs("shop", "orders")
    before = store.manifest(runs).groupBy("run_id").agg(F.sum("digest").alias("recorded")).toPandas()
    done = compact_rule(scene.spark, rule, store).select("run_id", "action", (F.col("files_before") > F.col("files_after")).alias("fewer_files"))
    [rows] = store.read(runs)
    found = grouped_totals(rows, {"run_id": F.col("run_id")}, scene.rows("orders").columns)
    keys = rows.groupBy("run_id").agg(F.sum("o_orderkey").alias("key_sum"), F.count_distinct(F.col("_metadata.file_name")).alias("files"))
    before = scene.spark.createDataFrame(before, "run_id string, recorded decimal(38,0)")
    return done.join(found, "run_id").join(keys, "run_id").join(before, "run_id").select(
        "run_id", "action", "fewer_files", "files", "rows", "key_sum", (F.col("digest") == F.col("recorded")).alias("same_digest"))


def chunk_intervals(spark, sf_dir):
    """Chunks with uneven bounds and a gap: rows, expiry, and whether they may be dropped; rows of no chunk stand apart."""
    scene = Scene(spark, sf_dir)
    scene.archive(rule_of(EVENTS), _chunked_events(scene), EVENTS_AS_OF, "0000aaaa", purge=False)
    events = scene.rows("events")
    changed = events.withColumn("value", F.when(F.col("ts") >= "2024-01-12", F.col("value") + 1).otherwise(F.col("value")))
    archived = _read_archive(scene, "events")
    told = intervals.interval_inventory(changed, "ts", CHUNK_BOUNDS, EVENTS_CUTOFF)
    dropped = intervals.droppable_intervals(changed, archived, "ts", CHUNK_BOUNDS, EVENTS_CUTOFF).select("name", F.lit(True).alias("droppable"))
    return told.join(dropped, "name", "left").select(
        F.coalesce("name", F.lit("none")).alias("name"), "rows", "expired", F.coalesce("droppable", F.lit(False)).alias("droppable"))


QUERIES = {
    f.__name__: f
    for f in (
        expired_rows, expired_events, expired_keys, expired_null_dates, kept_null_dates, retention_preview, preview_from_footers,
        batch_plan, batch_plan_composite, key_audit, key_report,
        purge_single_key, purge_composite_key, purge_hits, chunk_inventory, chunk_purge, purge_chunked_table,
        purge_accounting, purge_spares_late_rows, purge_repeated_key, purge_odd_weeks, adopt_schema_drift,
        archive_roundtrip, archive_publish, archive_abort, archive_idempotent, archive_manifest, archive_listing,
        archive_late_rows, archive_select,
        archive_rule, archive_all_rules, run_summary,
        restore_append, restore_one_run, restore_chunked_table, restore_preview, restore_preview_lost, restore_conflicts,
        restore_skip_existing, restore_schema_drift, restore_canonical,
        verify_archive, verify_unrecorded, verify_totals, incremental_verify, history_reconcile, history_reconcile_full,
        reconcile_empty_run, reconcile_after_lifecycle,
        history_append, history_files, history_recent, history_durations,
        canonical_encode, canonical_decode, canonical_bool, canonical_nested, canonical_by_db_type, canonical_narrowing,
        sanitize_identifiers, parse_archive_key, format_counts,
        archive_lifecycle, lifecycle_move, lifecycle_delete, lifecycle_resume, lifecycle_foreign_run,
        lifecycle_partial_failure, ageing_unreadable_run, history_segments,
        reconcile_rows, verify_row_groups, chunk_intervals, archive_compaction,
    )
}
