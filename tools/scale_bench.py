"""Time the event-based queries on a larger events table of the test shape.

    python tools/scale_bench.py [rows] [out_dir]

Writes an events table of ``rows`` rows (default 10M, 16 files) with the columns and value
ranges of the test events table, next to copies of the other test tables from sf0.1, into
``out_dir`` (default: a new temporary folder; nothing is written into the repository), then
times the event-based queries with the no-op sink. This is how the 10M column of
docs/SCALE.md was measured.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)

SOURCE = "/root/testdata/sf0.1"
QUERIES = ("stg_analytics_events", "mart_growth_daily", "mart_admin_usage", "mart_retention",
           "dq_unique_id", "dq_orphans")
EVENT_TYPES = ("click", "signup", "view", "purchase", "error")


def write_events(spark, path: str, rows: int) -> None:
    from pyspark.sql import functions as F

    types = F.array(*[F.lit(t) for t in EVENT_TYPES])
    events = spark.range(rows, numPartitions=16).select(
        F.col("id").alias("event_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(secs=F.col("id") * (2_592_000 / rows))).alias("ts"),
        (F.abs(F.xxhash64("id")) % 15000).alias("user_id"),
        F.element_at(types, (F.abs(F.xxhash64("id", F.lit(1))) % len(EVENT_TYPES) + 1)
                     .cast("int")).alias("event_type"),
        F.round(F.abs(F.xxhash64("id", F.lit(2))) % 5000 / 100.0, 2).alias("value"),
        F.concat(F.lit('{"k": '), (F.col("id") % 100).cast("string"), F.lit("}")).alias("props"),
    )
    events.write.mode("overwrite").parquet(path)


def main() -> None:
    from sparkmarts.plans.registry import queries
    from sparkmarts.session import local_session

    rows = int(sys.argv[1]) if len(sys.argv) > 1 else 10_000_000
    out = sys.argv[2] if len(sys.argv) > 2 else tempfile.mkdtemp(prefix="sparkmarts-scale-")
    spark = local_session(cores=8, shuffle_partitions=64, app="sparkmarts-scale")
    write_events(spark, f"{out}/events.parquet", rows)
    for table in ("customer", "part", "orders", "lineitem"):
        shutil.copy(f"{SOURCE}/{table}.parquet", f"{out}/{table}.parquet")
    q = queries()
    timings = {}
    for name in QUERIES:
        best = None
        for _ in range(2):
            t0 = time.perf_counter()
            q[name](spark, out).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        timings[name] = round(best, 2)
    print(json.dumps({"rows": rows, "dir": out, "sec": timings}))
    spark.stop()


if __name__ == "__main__":
    main()
