"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The stored tables (bronze lines, change events, resources, variance) are timed on their own as
``build_*``, so a report's time is the time of the report. ``variance_pipeline`` goes from the given
tables to the report without reading any stored table.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from spendweave.plans.variance import run_pipeline
from spendweave.testbed import tables
from spendweave.testbed.queries import QUERIES, plain

HEADLINE = [
    "dedup_new_lines", "invoices", "resources", "iac_match_fuzzy", "logical_resources", "allocate_lines",
    "change_event_match", "pr_resource_match", "variance_pairs", "rolling_3m_baseline", "classify", "evidence_chain",
    "int_invoice_totals", "int_monthly_resource_spend", "dim_resources", "fct_variance_report", "variance_by_service",
    "root_causes", "top5_per_bucket", "anomalies", "close_packet", "forecast_by_service", "cost_describe", "dq_duplicates",
    "dq_reconciliation", "import_priority", "chunk_docs", "vector_topk",
]


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    chosen = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("spendweave-bench")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "20g")
        .config("spark.sql.shuffle.partitions", str(max(8, int(cpus))))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def pipeline() -> None:
        drain(plain(run_pipeline(
            tables.mapped_lines(spark, sf_dir), tables.iac_index(spark, sf_dir), tables.mapped_events(spark, sf_dir))))

    times: dict[str, float] = {}
    for name, table in (
        ("build_lines", tables.billing_lines), ("build_events", tables.change_events),
        ("build_resources", tables.gold_resources), ("build_variance", tables.gold_variance),
    ):
        times[name] = timed(lambda table=table: table(spark, sf_dir))
    times["variance_pipeline"] = timed(pipeline)
    for name in chosen:
        runs = sorted(timed(lambda name=name: drain(QUERIES[name](spark, sf_dir))) for _ in range(repeats))
        times[name] = runs[len(runs) // 2]
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
