"""Times the headline queries and prints one JSON line.

Every query reads its input anew and its result is produced in full, without
being written.  Each runs three times and the median counts; the runs of one
hundred million values count once.  Intermediate tables go to one folder and are
deleted after each run.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from runweave.operators import global_sort
from runweave.plans import QUERIES
from runweave.sources import generate_uniform
from runweave.storage import release

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3

HEADLINE = [
    "global_position_of_values",
    "global_position_of_rows",
    "global_position_hot_key",
    "global_sort_order",
    "global_sort_hot_key",
    "sorted_runs_order",
    "merge_runs_order",
    "range_merge_order",
    "range_pivots_stride",
    "assign_range_rows",
    "range_histogram_rows",
    "assign_chunks_rows",
    "apportion_weighted",
    "number_file_sorted",
    "generate_uniform_rows",
    "generate_sorted_rows",
    "check_sorted_violations",
    "check_conserved_sorted",
    "check_complete_faults",
    "audit_seeds_ledger",
    "node_contribution_ledger",
    "preview_values",
    "ledger_view_rows",
    "compare_runs_history",
    "scaling_curve_history",
    "source_sessions_batch",
    "live_sources_now",
    "stream_runs_merged",
]


def values(spark: SparkSession, n: int):
    return generate_uniform(spark, n, seed=1).select("v")


#: Generated and sorted, generation included: the size of the published
#: single-machine numbers and ten times as much, each beside a plain orderBy.
SIZES = {
    "sort_10m_generated": (lambda spark, _: global_sort(values(spark, 10_000_000), "v"), RUNS),
    "plain_10m_order_by": (lambda spark, _: values(spark, 10_000_000).orderBy("v"), RUNS),
    "sort_100m_generated": (lambda spark, _: global_sort(values(spark, 100_000_000), "v"), 1),
    "plain_100m_order_by": (lambda spark, _: values(spark, 100_000_000).orderBy("v"), 1),
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo = {name: (QUERIES[name], RUNS) for name in HEADLINE} | SIZES
    spent = {}
    for name, (query, runs) in todo.items():
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            release(spark)
        spent[name] = round(statistics.median(times), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
