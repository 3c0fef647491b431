"""Headline queries of node ranking at $BENCH_SF_DIR on local[$BENCH_CPUS]: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

HEADLINE = ("degrees", "norm_symmetric", "pagerank_quotient_k", "pagerank_closed_k", "heat_kernel_k", "absorbing_k", "lowpass_k", "ordinals", "threshold_gap", "sweep", "fair_lfpro", "measure_auc", "measure_conductance", "measure_modularity")


def main() -> None:
    from pyspark.sql import SparkSession

    from diffusio import queries

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "node_ranking_total_sec", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
