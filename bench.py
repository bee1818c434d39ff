"""Benchmark the headline queries; print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3), BENCH_WARMUPS (default 2), BENCH_PARTITIONS (default
BENCH_CPUS), BENCH_QUERIES (comma list, default the headline set).

Each query is fully executed with the ``noop`` sink (every row produced, none
collected to the driver); the value per query is the median of the timed runs
after the warm-up runs (JIT-compiled code paths settle by then).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "capture_diff",
    "net_changes",
    "upsert_partial",
    "apply_changes",
    "reconcile_totals",
    "change_feed",
    "nest_items",
    "check_unique",
    "catalog_capture_candidates",
    "assign_ids",
    "doc_upsert",
    "fk_lookup",
    "strict_lookup",
    "check_foreign_key",
    "kafka_records",
    "unnest_items",
    "seed_orders",
    "net_changes_events",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    warmups = int(os.environ.get("BENCH_WARMUPS", "2"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]

    from changeflow.session import build_session
    from changeflow.plans.registry import QUERIES

    partitions = int(os.environ.get("BENCH_PARTITIONS", str(cpus)))
    spark = build_session(master=f"local[{cpus}]", partitions=partitions)
    times: dict[str, float] = {}
    for name in names:
        fn = QUERIES[name]
        samples = []
        for i in range(warmups + runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i >= warmups:
                samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_total_median",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "runs": runs,
        "warmups": warmups,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
