"""Time the headline queries: prints one JSON line, seconds per query.

Each query runs once to warm up and then three times; the median counts. Jobs are timed
without what is set up for them (tables loaded, earlier runs archived), from their start to
the last row of their result.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from coldkeep.queries import JOBS, QUERIES, Scene

HEADLINE = [
    "retention_preview", "expired_rows", "batch_plan", "key_audit", "purge_single_key", "purge_composite_key",
    "chunk_inventory", "archive_roundtrip", "chunk_purge", "archive_rule", "restore_append", "verify_archive",
    "history_reconcile", "canonical_encode", "canonical_decode",
]
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("retention-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_CHECKPOINT_DIR", "file:" + tempfile.mkdtemp(prefix="bench-")))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        taken = []
        for _ in range(REPEATS + 1):
            run = QUERIES[name]
            if name in JOBS:
                prepare, then = JOBS[name]
                scene = Scene(spark, sf_dir)
                made = prepare(scene)
                run = lambda *_, scene=scene, made=made, then=then: then(scene, made)
            start = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({
        "metric": "total_median_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
