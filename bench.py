"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession

from keyscape.session import run_scope
from keyscape.testbed.catalogue import QUERIES

HEADLINE = ["edges", "top_servers", "nodes", "responder_cardinality", "temporal_class",
            "role_assertions", "alternate_providers", "pagerank", "rank", "betweenness_pivots", "snapshot_scan"]
#: Each query's time is the median of its runs; one run if the first is long.
RUNS, LONG_S = 3, 40


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("keyscape-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="keyscape-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["mac_coverage"](spark, sf_dir).collect()  # start the engine
    times = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            with run_scope(spark):
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
            if runs[0] > LONG_S:
                break
        times[name] = round(median(runs), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf.group(1)) if sf else None,
    }))


if __name__ == "__main__":
    main()
