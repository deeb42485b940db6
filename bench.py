"""Time the headline queries; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from fleetlens.plans import CATALOG

HEADLINE = (
    "parse_log_records",
    "repo_ledger",
    "auth_failures_in_window",
    "log_findings",
    "scan_candidates",
    "queue_inventory",
    "marker_scan",
    "keyword_rules",
    "secrets_in_documents",
    "scan_secrets",
    "secret_hits",
    "config_state_of_homes",
    "host_verdicts",
)

WARM_DIR = "/root/testdata/sf0.001"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    # Compiled code and Python workers are warm before the clock starts.
    for name in names if os.environ.get("BENCH_WARM", "1") == "1" else ():
        CATALOG[name].run(spark, WARM_DIR).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        CATALOG[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
