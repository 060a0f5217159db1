"""Benchmark: the six marts (and the dashboard KPI row) over the driver tables.

Runs on local[$BENCH_CPUS] against $BENCH_SF_DIR (default /root/testdata/sf0.1) and prints ONE
JSON line. Each query is executed in full with the no-op sink (every row is computed, nothing is
sent to the driver); the reported time per query is the best of $BENCH_REPEAT runs after one
warm-up query on the smallest scale factor. "value" is the sum over the six marts.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = (
    "mart_growth_daily",
    "mart_admin_usage",
    "mart_product_activity",
    "mart_finance",
    "mart_retention",
    "mart_entity_ranking",
)
EXTRA = ("dash_kpis", "dq_unique_id")


def main() -> None:
    from sparkmarts.plans.registry import queries
    from sparkmarts.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = local_session(cores=cpus, shuffle_partitions=int(os.environ.get(
        "BENCH_SHUFFLE_PARTITIONS", "8")), app="sparkmarts-bench")
    q = queries()

    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        q["mart_growth_daily"](spark, warm).write.format("noop").mode("overwrite").save()

    timings: dict[str, float] = {}
    for name in HEADLINE + EXTRA:
        best = None
        for _ in range(max(1, repeat)):
            t0 = time.perf_counter()
            q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        timings[name] = round(best, 3)

    sf = os.path.basename(sf_dir).removeprefix("sf")
    try:
        sf_value: float | str = float(sf)
    except ValueError:
        sf_value = sf
    print(json.dumps({
        "metric": "six_marts_total_sec",
        "value": round(sum(timings[n] for n in HEADLINE), 3),
        "unit": "sec",
        "queries": timings,
        "sf": sf_value,
        "cpus": cpus,
        "mode": "noop sink, best of %d" % repeat,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
