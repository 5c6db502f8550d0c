"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the number of cores. Each query is built
and run to the end, all columns included, ``BENCH_RUNS`` times after a warm-up; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lakestrata.session import build_session, release_scratch  # noqa: E402
from lakestrata.workload import load_all  # noqa: E402

HEADLINE = [
    "product_sales_month", "spend_by_nation_premium", "monthly_revenue", "daily_active_users", "daily_sales_summary",
    "metric_statistics", "trailing_30d", "top_products_per_month", "first_last_status", "previous_event",
    "dense_surrogate_keys", "pivot_events", "column_profile", "dimension_enrichment", "orphan_foreign_keys",
    "predicate_mix", "row_overlap", "domain_tags", "dwd_latest_lines", "inferred_rollup", "layer_backfill",
    "layer_run_written", "upsert_customers", "merge_customers", "upsert_partitions", "scd2_history",
    "scd2_incremental", "quality_report", "quarantine_split", "similar_vectors", "similarity_bands",
    "compare_tables", "trace_downstream", "trace_upstream", "lineage_cycles", "flow_compliance",
    "convention_violations", "convention_scores", "catalog_search", "statement_complexity", "edges_from_log",
    "route_messages", "stream_hourly_rollup",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    registry["metric_statistics"].build(spark, folder).count()  # starts the JVM's code paths
    registry["pandas_batch_step"].build(spark, folder).count()  # starts the Python workers
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs):
            begin = time.perf_counter()
            registry[name].build(spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(taken), 3)
        release_scratch(spark)
    line = {
        "metric": "total_seconds_headline_queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
