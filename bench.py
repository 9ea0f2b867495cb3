"""Times the headline graph queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set data and cores."""

import json
import os
import time

from pyspark.sql import SparkSession

from graphweave.plans.registry import QUERIES

HEADLINE = ["reachability", "reachable_sinks", "graph_flatten", "call_resolution_confidence", "method_resolution", "primary_path", "severity_adjust", "taint_mask_union", "innermost_span", "findings_with_paths", "fingerprint_diff", "incremental_invalidation"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/nation.parquet").count()
    took = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
