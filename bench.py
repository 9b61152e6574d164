"""Headline queries, timed. Prints one JSON line.

Each query runs once untimed (code generation, JIT) and then twice; the better run counts. Results go to the
``noop`` sink, so the whole result is computed and nothing is brought to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyform.workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "conform_accepted", "conform_quarantine", "conform_summary", "errors_by_field_rule", "orders_accepted",
    "orders_summary", "type_coercion_accepted", "profile_crm", "profile_documents", "profile_orders",
    "profile_top_values", "infer_schema_lineitem", "rule_date_iso_orders", "rule_trim_clean_documents",
    "upsert_actions", "upsert_merged", "key_duplicates", "primary_key_collisions", "reconcile_all_runs",
    "money_reconciliation", "remediation_impact",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyform-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="tallyform-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for attempt in range(3):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if attempt and (best is None or took < best):
                best = took
        times[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
