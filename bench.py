"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Every query runs once to
warm up the JVM and then BENCH_RUNS times; the median counts. Results go to
the no-op sink, so all rows are computed and none are collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tableflow.plans.queries import QUERIES
from tableflow.session import build_session

HEADLINE = [
    "z1_daily_fares", "z2_borough_list", "z2_partition_manifest", "z3_rolling_revenue",
    "z4_by_payment", "z4_by_hour", "z5_daily_totals", "z8_payment_reports", "z9_measures",
    "z10_borough_day", "z10_report", "z11_extract", "distinct_rows", "bucket_sums", "rolling_events",
    "history_latest", "history_run_summary", "history_task_stats", "merge_insert_absent",
    "merge_replace_key", "merge_upsert_latest", "fp_table", "fp_changed_partitions", "refresh_preview",
    "snap_diff", "pii_scan", "pii_documents", "lineage_descendants", "cost_rollup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", cores, spark__sql__shuffle__partitions=cores)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of median wall clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
