"""Independent SQL for the registered queries, over the same whole tables."""

from __future__ import annotations

C = "TIMESTAMP '1997-01-01'"
E = "TIMESTAMP '2024-01-17'"
# Half-open date ranges of the three successive runs over orders.
STEPS = """(VALUES
    ('00000001', TIMESTAMP '0001-01-01', TIMESTAMP '1995-07-01'),
    ('12e45678', TIMESTAMP '1995-07-01', TIMESTAMP '1996-01-01'),
    ('c0ffee03', TIMESTAMP '1996-01-01', TIMESTAMP '1997-01-01')) AS steps(run_id, low, high)"""
# The runs with their rows, numbered in key order.
NUMBERED = f"""SELECT run_id, (row_number() OVER (PARTITION BY run_id ORDER BY o_orderkey) - 1) // 1000 AS batch
    FROM orders JOIN {STEPS} ON o_orderdate >= low AND o_orderdate < high"""
UNDATED = "SELECT * REPLACE (CASE WHEN event_type <> 'error' THEN ts END AS ts) FROM events"
WEEK = "date_trunc('week', ts)"
WEEK_OVER = f"{WEEK} + INTERVAL 7 DAY <= {E}"
# Weeks that begin on Thursdays.
ODD_WEEK = "date_trunc('week', ts - INTERVAL 3 DAY) + INTERVAL 3 DAY"
ODD_OVER = f"{ODD_WEEK} + INTERVAL 7 DAY <= {E}"


def _batches(source: str, key: tuple[str, ...]) -> str:
    order = ", ".join(key)
    first = ", ".join(f"arg_min({k}, n) AS first_{k}, arg_max({k}, n) AS last_{k}" for k in key)
    return f"""SELECT n // 1000 AS batch, lpad(CAST(n // 1000 AS VARCHAR), 3, '0') AS batch_name,
            count(*) AS rows, {first}
        FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS n FROM {source})
        GROUP BY n // 1000"""


def _key_report(table: str, key: str) -> str:
    return f"""SELECT '{table}' AS table_name, (SELECT count(*) FROM {table}) AS rows, CAST(0 AS BIGINT) AS null_key_rows,
            count(*) AS duplicate_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows
        FROM (SELECT count(*) AS n FROM {table} GROUP BY {key} HAVING count(*) > 1)"""


def _summary(rule: str, table: str, archived: str, chunked: str, remaining: str) -> str:
    return f"""SELECT '{rule}' AS rule, '{table}' AS table_name,
            count(*) FILTER (WHERE {archived}) AS rows_archived,
            count(*) FILTER (WHERE {chunked}) AS chunk_deleted,
            count(*) FILTER (WHERE ({archived}) AND NOT ({chunked})) AS key_deleted,
            count(*) FILTER (WHERE {remaining}) AS rows_remaining, false AS mismatch
        FROM {table}"""


ORDERS_ALL = "SELECT * FROM orders"
EVENTS_ALL = "SELECT * FROM events"

# Status of each file when the first batch of every run is damaged or lost.
DAMAGED = f"""SELECT run_id, batch,
        CASE WHEN batch > 0 THEN 'OK' WHEN run_id = 'c0ffee03' THEN 'MISSING' ELSE 'CORRUPT' END AS status,
        CASE WHEN batch > 0 THEN count(*) ELSE 0 END AS rows
    FROM ({NUMBERED}) GROUP BY run_id, batch"""

RECONCILED = f"""SELECT run_id, 'orders' AS table_name,
        count(*) + CASE WHEN run_id = '12e45678' THEN 1 ELSE 0 END AS expected_rows,
        CASE WHEN run_id <> 'c0ffee03' THEN count(*) ELSE 0 END AS actual_rows,
        CASE run_id WHEN '00000001' THEN 'match' WHEN '12e45678' THEN 'mismatch' ELSE 'missing' END AS status
    FROM ({NUMBERED}) GROUP BY run_id"""


def _history_event(number: int, run: str, kind: str, rule_table: str, count: str, folder: str | None) -> str:
    files = f"'[\"shop/orders/{folder}\"]'" if folder else "'[]'"
    failed = "true" if folder is None else "false"
    return f"""SELECT CAST({number} AS BIGINT) AS id, '{run}' AS run_id, 'keep-online' AS rule, '{kind}' AS event_type,
            '{rule_table}' AS table_name, {count} AS row_count, {files} AS files,
            '{"error" if folder is None else "success"}' AS status, {failed} AS has_error_message
        FROM orders"""


ORACLES = {
    "expired_rows": f"SELECT * FROM orders WHERE o_orderdate < {C}",
    "expired_events": f"SELECT * FROM events WHERE ts < {E}",
    "expired_keys": f"SELECT ts, user_id FROM events WHERE ts < {E}",
    "expired_null_dates": f"SELECT * FROM ({UNDATED}) WHERE ts < {E}",
    "kept_null_dates": f"SELECT * FROM ({UNDATED}) WHERE ts >= {E} OR ts IS NULL",
    "retention_preview": f"""
        SELECT 'orders' AS table_name, count(*) AS expired_rows, {C} AS cutoff FROM orders WHERE o_orderdate < {C}
        UNION ALL SELECT 'lineitem', count(*), {C} FROM lineitem WHERE l_shipdate < {C}
        UNION ALL SELECT 'events', count(*), {E} FROM events WHERE ts < {E}""",
    "preview_from_footers": f"""
        SELECT 'orders' AS table_name, count(*) FILTER (WHERE o_orderdate < {C}) AS expired_rows, {C} AS cutoff FROM orders
        UNION ALL SELECT 'lineitem', count(*) FILTER (WHERE l_shipdate < {C}), {C} FROM lineitem
        UNION ALL SELECT 'events', count(*) FILTER (WHERE ts < {E}), {E} FROM events""",
    "batch_plan": _batches(f"(SELECT * FROM orders WHERE o_orderdate < {C})", ("o_orderkey",)),
    "batch_plan_composite": _batches(f"(SELECT * FROM events WHERE ts < {E})", ("ts", "user_id")),
    "key_audit": """
        SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem
        GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "key_report": " UNION ALL ".join([
        _key_report("orders", "o_orderkey"),
        _key_report("events", "ts, user_id"),
        _key_report("lineitem", "l_orderkey, l_linenumber"),
        _key_report("conversations", "conv_id, turn"),
    ]),
    "purge_single_key": f"""
        SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < {C})""",
    "purge_composite_key": f"""
        SELECT * FROM events e WHERE NOT EXISTS (
            SELECT 1 FROM events x WHERE x.ts < {E} AND x.ts = e.ts AND x.user_id = e.user_id)""",
    "purge_hits": f"""
        SELECT count(*) AS rows_hit, count(*) FILTER (WHERE l_shipdate >= {C}) AS unexpired_rows_hit
        FROM lineitem SEMI JOIN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate < {C}) k
        USING (l_orderkey, l_linenumber)""",
    "chunk_inventory": f"""
        SELECT {WEEK} AS chunk_start, {WEEK} + INTERVAL 7 DAY AS chunk_end, count(*) AS rows, {WEEK_OVER} AS expired
        FROM events GROUP BY ALL""",
    "chunk_purge": f"SELECT * FROM events WHERE NOT ({WEEK_OVER})",
    "purge_chunked_table": f"SELECT * FROM events WHERE ts >= {E}",
    "purge_accounting": f"""
        SELECT count(*) FILTER (WHERE ts < {E}) AS rows_archived,
            count(DISTINCT {WEEK}) FILTER (WHERE {WEEK_OVER}) AS chunks_dropped,
            count(*) FILTER (WHERE {WEEK_OVER}) AS chunk_deleted,
            count(*) FILTER (WHERE ts < {E} AND NOT ({WEEK_OVER})) AS key_deleted,
            count(*) FILTER (WHERE ts >= {E}) AS rows_remaining, false AS mismatch
        FROM events""",
    "purge_spares_late_rows": f"""
        SELECT * FROM events WHERE ts >= {E}
        UNION ALL
        SELECT * REPLACE (-user_id - 1 AS user_id) FROM events WHERE ts < {E} AND event_type = 'error'""",
    "purge_repeated_key": f"""
        SELECT * FROM events WHERE ts >= {E}
        UNION ALL SELECT * REPLACE (value + 1 AS value) FROM events WHERE ts < {E} AND event_type = 'error'""",
    "purge_odd_weeks": f"""
        SELECT count(*) FILTER (WHERE ts < {E}) AS rows_archived,
            count(DISTINCT {ODD_WEEK}) FILTER (WHERE {ODD_OVER}) AS chunks_dropped,
            count(*) FILTER (WHERE {ODD_OVER}) AS chunk_deleted,
            count(*) FILTER (WHERE ts < {E} AND NOT ({ODD_OVER})) AS key_deleted,
            count(*) FILTER (WHERE ts >= {E}) AS rows_remaining, false AS mismatch
        FROM events""",
    "adopt_schema_drift": f"""
        SELECT *, CASE WHEN ts >= TIMESTAMP '2024-01-08' THEN upper(event_type) END AS kind,
            CASE WHEN ts < {E} THEN 'archive' ELSE 'hot' END AS tier
        FROM events""",
    "archive_roundtrip": f"SELECT * FROM orders WHERE o_orderdate < {C}",
    "archive_publish": f"""
        SELECT CAST(0 AS BIGINT) AS runs_visible_while_staged, CAST(1 AS BIGINT) AS pending_while_staged,
            CAST(0 AS BIGINT) AS pending_after, count(*) AS rows_published
        FROM orders WHERE o_orderdate < {C}""",
    "archive_abort": """
        SELECT 'orders' AS table_name, count(*) AS hot_rows, CAST(0 AS BIGINT) AS error_events,
            CAST(0 AS BIGINT) AS pending_runs, CAST(0 AS BIGINT) AS published_runs FROM orders
        UNION ALL SELECT 'lineitem', count(*), 1, 0, 0 FROM lineitem""",
    "archive_idempotent": f"""
        SELECT '00000001' AS run_id, count(*) FILTER (WHERE o_orderdate < {C}) AS rows_archived,
            count(*) FILTER (WHERE o_orderdate >= {C}) AS rows_remaining FROM orders
        UNION ALL SELECT '00000002', 0, count(*) FILTER (WHERE o_orderdate >= {C}) FROM orders""",
    "archive_manifest": f"""
        SELECT '1997-01-01' AS cutoff_date, '12e45678' AS run_id, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS files,
            count(*) AS rows, least(count(*), 1000) AS largest_file
        FROM orders WHERE o_orderdate < {C}""",
    "archive_listing": f"""
        SELECT strftime(any_value(high), '%Y-%m-%d') AS cutoff_date, run_id, count(DISTINCT batch) AS files,
            count(DISTINCT batch) AS sized_and_dated, count(*) AS rows
        FROM (SELECT run_id, high, (row_number() OVER (PARTITION BY run_id ORDER BY o_orderkey) - 1) // 1000 AS batch
            FROM orders JOIN {STEPS} ON o_orderdate >= low AND o_orderdate < high)
        GROUP BY run_id""",
    "archive_late_rows": f"""
        SELECT * FROM orders WHERE o_orderdate < {C}
            AND (o_orderdate >= '1996-01-01' OR o_orderpriority = '1-URGENT')""",
    "archive_select": "SELECT * FROM orders WHERE o_orderdate >= '1995-07-01' AND o_orderdate < '1996-01-01'",
    "archive_rule": " UNION ALL ".join([
        _summary("keep-online", "orders", f"o_orderdate < {C}", "false", f"o_orderdate >= {C}"),
        _summary("keep-online", "events", f"ts < {E}", WEEK_OVER, f"ts >= {E}"),
    ]),
    "archive_all_rules": " UNION ALL ".join([
        _summary("orders", "orders", f"o_orderdate < {C}", "false", f"o_orderdate >= {C}"),
        _summary("events", "events", f"ts < {E}", "false", f"ts >= {E}"),
    ]).replace("AS mismatch", "AS mismatch, 'success' AS status")
    + " UNION ALL SELECT 'lineitem', 'lineitem', 0, 0, 0, count(*), false, 'error' FROM lineitem"
    + " UNION ALL SELECT 'returns', 'returns', 0, 0, 0, -1, false, 'error'",
    "run_summary": f"""
        SELECT run_id, count(*) AS rows_archived, count(*) AS rows_deleted, count(DISTINCT batch) AS files
        FROM ({NUMBERED}) GROUP BY run_id""",
    "restore_append": ORDERS_ALL,
    "restore_one_run": f"""
        SELECT * FROM orders WHERE o_orderdate >= {C}
        UNION ALL SELECT * FROM orders WHERE o_orderdate >= '1995-07-01' AND o_orderdate < '1996-01-01'""",
    "restore_chunked_table": EVENTS_ALL,
    "restore_preview": f"""
        SELECT 'orders' AS table_name, count(DISTINCT (run_id, batch)) AS files, count(*) AS rows FROM ({NUMBERED})""",
    "restore_preview_lost": f"""
        SELECT 'orders' AS table_name, count(DISTINCT (run_id, batch)) AS files, count(*) AS rows
        FROM ({NUMBERED}) WHERE batch > 0""",
    "restore_conflicts": "SELECT o_orderkey FROM orders WHERE o_orderdate < '1996-01-01'",
    "restore_skip_existing": ORDERS_ALL,
    "restore_schema_drift": """
        SELECT * REPLACE (CASE WHEN o_orderdate >= '1996-01-01' THEN o_orderpriority END AS o_orderpriority)
        FROM orders""",
    "restore_canonical": EVENTS_ALL,
    "verify_archive": DAMAGED,
    "verify_unrecorded": f"""
        SELECT 'aaaa0001' AS run_id, 'OK' AS status, count(*) AS rows FROM orders WHERE o_orderdate < {C}
        UNION ALL SELECT 'aaaa0002', 'OK', 0
        UNION ALL SELECT 'aaaa0003', 'OK', count(*) FROM orders WHERE o_orderdate < {C}
        UNION ALL SELECT 'aaaa0003', 'CORRUPT', 0""",
    "verify_totals": f"""
        SELECT 'orders' AS table_name, count(*) FILTER (WHERE status = 'OK') AS ok_files,
            count(*) FILTER (WHERE status = 'CORRUPT') AS corrupt_files,
            count(*) FILTER (WHERE status = 'MISSING') AS missing_files, CAST(sum(rows) AS BIGINT) AS rows
        FROM ({DAMAGED})""",
    "incremental_verify": f"""
        SELECT run_id, CASE run_id WHEN '00000001' THEN 0 WHEN '12e45678' THEN 1 ELSE 2 END::BIGINT AS pass,
            CAST(0 AS BIGINT) AS bad_files, count(*) AS rows
        FROM ({NUMBERED}) GROUP BY run_id""",
    "history_reconcile": f"SELECT * FROM ({RECONCILED}) WHERE status <> 'missing'",
    "history_reconcile_full": RECONCILED,
    "reconcile_empty_run": f"""
        SELECT '00000001' AS run_id, 'orders' AS table_name, count(*) AS expected_rows, count(*) AS actual_rows, 'match' AS status
        FROM orders WHERE o_orderdate < {C}
        UNION ALL SELECT '00000002', 'orders', 0, 0, 'empty'""",
    "reconcile_after_lifecycle": f"""
        SELECT run_id, 'orders' AS table_name, count(*) AS expected_rows, CAST(0 AS BIGINT) AS actual_rows,
            CASE run_id WHEN '00000001' THEN 'expired' WHEN '12e45678' THEN 'moved' ELSE 'missing' END AS status
        FROM ({NUMBERED}) GROUP BY run_id""",
    "history_append": " UNION ALL ".join([
        _history_event(1, "00000001", "archive", "orders", "count(*) FILTER (WHERE o_orderdate < '1996-01-01')",
                       "cutoff_date=1996-01-01/run_id=00000001"),
        _history_event(2, "00000002", "archive", "orders",
                       f"count(*) FILTER (WHERE o_orderdate >= '1996-01-01' AND o_orderdate < {C})",
                       "cutoff_date=1997-01-01/run_id=00000002"),
        _history_event(3, "00000003", "archive", "lineitem", "count(*) * 0", None),
        _history_event(4, "restore", "restore", "orders",
                       f"count(*) FILTER (WHERE o_orderdate >= '1996-01-01' AND o_orderdate < {C})",
                       "cutoff_date=1997-01-01/run_id=00000002"),
    ]),
    "history_files": """
        SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 1 ELSE 2 END::BIGINT AS n_files,
            CASE WHEN event_type = 'error' THEN '' ELSE event_type || '|' END || format('{:08x}', user_id) AS joined
        FROM events""",
    "history_recent": """
        SELECT event_id AS id, format('{:08x}', user_id) AS run_id, event_type AS rule, ts AS start_time
        FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20""",
    "history_durations": """
        SELECT user_id, min(ts) AS start_time, max(ts) AS end_time, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us
        FROM events GROUP BY user_id""",
    "canonical_encode": r"""
        SELECT * REPLACE (regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\.?0+$', '') || 'Z' AS ts) FROM events""",
    "canonical_decode": EVENTS_ALL,
    "canonical_bool": "SELECT event_id, event_type = 'error' AS is_error, CAST(value AS FLOAT) AS value FROM events",
    "canonical_nested": "SELECT event_id, ts, user_id, ts AS again FROM events",
    "canonical_by_db_type": r"""
        SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus, o_totalprice,
            strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' AS o_orderdate, CAST(NULL AS VARCHAR) AS o_comment
        FROM orders""",
    "canonical_narrowing": """
        SELECT o_orderkey,
            CAST((o_orderkey * 1000003 + 2147483648) % 4294967296 - 2147483648 AS INTEGER) AS wrapped,
            CAST(trunc(-o_totalprice) AS BIGINT) AS truncated
        FROM orders""",
    "sanitize_identifiers": "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') AS name FROM pages",
    "parse_archive_key": """
        SELECT o_orderkey,
            'shop_db/order_lines/' || strftime(o_orderdate, '%Y-%m-%d') || '/' || file_name AS archive_key,
            file_name, format('{:08x}', o_orderkey) AS run_id,
            month(o_orderdate) = 7 AS mentions_july
        FROM (SELECT *, format('{:08x}_{:03d}.parquet', o_orderkey, o_custkey) AS file_name FROM orders)""",
    "format_counts": """
        SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT) * o_custkey) AS count_text FROM orders""",
    "archive_lifecycle": """
        SELECT CASE WHEN age >= 1460 THEN 'expire' WHEN age >= 30 THEN 'transition' ELSE 'keep' END AS action,
            count(DISTINCT o_orderdate) AS archives, count(*) AS rows
        FROM (SELECT o_orderdate, floor((epoch(TIMESTAMP '2000-01-01') - epoch(o_orderdate)) / 86400) AS age FROM orders)
        GROUP BY ALL""",
    "lifecycle_move": f"""
        SELECT *, CASE WHEN o_orderdate < '1996-01-01' THEN 'cold' ELSE 'archive' END AS tier
        FROM orders WHERE o_orderdate < {C}""",
    "lifecycle_resume": f"""
        SELECT run_id, count(*) AS rows, CASE run_id WHEN '12e45678' THEN 'cold' ELSE 'archive' END AS tier
        FROM ({NUMBERED}) WHERE run_id <> '00000001' GROUP BY run_id""",
    "lifecycle_foreign_run": f"""
        SELECT run_id, count(*) AS rows, 'expire' AS action FROM ({NUMBERED}) GROUP BY run_id
        UNION ALL SELECT 'f0e1d2c3', count(*), 'keep' FROM orders WHERE o_orderdate >= {C}""",
    "lifecycle_partial_failure": f"""
        SELECT run_id, 'orders' AS table_name, count(*) AS expected_rows, CAST(0 AS BIGINT) AS actual_rows,
            CASE WHEN seen = 'after' OR run_id = '00000001' THEN 'expired' ELSE 'interrupted' END AS status, seen
        FROM ({NUMBERED}), (VALUES ('before'), ('after')) AS times(seen) GROUP BY run_id, seen""",
    "ageing_unreadable_run": f"""
        SELECT *, CAST(2 AS BIGINT) AS unrecorded_runs FROM (
            SELECT run_id, count(*) AS rows, 'expire' AS action FROM ({NUMBERED}) GROUP BY run_id
            UNION ALL SELECT 'f0e1d2c3', count(*), 'keep' FROM orders WHERE o_orderdate >= {C}
            UNION ALL SELECT 'badbadba', 0, 'unreadable')""",
    "history_segments": """
        SELECT event_id AS id, format('{:08x}', user_id) AS run_id, event_type AS rule, ts AS start_time, true AS merged
        FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20""",
    "reconcile_rows": f"""
        SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'missing' ELSE 'changed' END AS status, CAST(1 AS BIGINT) AS expected_rows,
            CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE 1 END::BIGINT AS actual_rows
        FROM orders WHERE o_orderdate < {C} AND (o_orderkey % 97 = 0 OR o_orderkey % 89 = 1)
        UNION ALL SELECT -o_orderkey - 1, 'extra', 0, 1 FROM orders WHERE o_orderdate < {C} AND o_orderkey % 97 = 0""",
    "verify_row_groups": f"""
        SELECT run_id, CASE run_id WHEN '12e45678' THEN 1 ELSE 0 END::BIGINT AS damaged_groups,
            CASE run_id WHEN '12e45678' THEN 1 ELSE 0 END::BIGINT AS planted_groups, count(*) AS rows,
            CASE run_id WHEN '12e45678' THEN 1 ELSE 0 END::BIGINT AS read_again
        FROM ({NUMBERED}) GROUP BY run_id""",
    "archive_compaction": f"""
        SELECT run_id, 'compacted' AS action, true AS fewer_files, CAST(1 AS BIGINT) AS files, count(*) AS rows,
            CAST(sum(o_orderkey) AS BIGINT) AS key_sum, true AS same_digest
        FROM orders JOIN {STEPS} ON o_orderdate >= low AND o_orderdate < high GROUP BY run_id""",
    "chunk_intervals": f"""
        SELECT coalesce(name, 'none') AS name, count(ts) AS rows, coalesce(high <= {E}, false) AS expired,
            coalesce(name IN ('c1', 'c2'), false) AS droppable
        FROM (VALUES ('c1', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-04 06:00:00'), ('c2', TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-12'),
            ('c3', TIMESTAMP '2024-01-12', {E}), ('c4', {E}, TIMESTAMP '2024-01-25 12:30:00'),
            ('c5', TIMESTAMP '2030-01-01', TIMESTAMP '2031-01-01')) AS bounds(name, low, high)
        FULL JOIN events ON ts >= low AND ts < high GROUP BY name, high""",
    "lifecycle_delete": f"SELECT * FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < {C}",
}
