"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from canopygrid.catalog.queries import QUERIES

HEADLINE = [
    "combined_mask",
    "derived_maps",
    "map_algebra_functions",
    "price_histogram",
    "euclidean_distance",
    "risk_threshold",
    "frequency_table",
    "frequency_table_alternative",
    "imputed_frequency",
    "adjusted_density",
    "evaluation_cells",
    "evaluation_statistics",
    "mask_parts",
    "alloc_mask",
    "stratum_opening",
    "rasterized_divisions",
    "decimal_years",
    "workflow_benchmark",
    "workflow_alternative",
    "evaluation_stage",
    "euclidean_distance_tiled",
    "top_pixels_per_division",
    "median_and_slope_distributed",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["combined_mask"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
