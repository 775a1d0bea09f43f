"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from headroom.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "cleaned_costs",
    "clean_trace",
    "time_gaps",
    "window_aggregate",
    "machine_profiles",
    "scaled_features",
    "kmeans_clusters",
    "silhouette_exact",
    "dbscan_labels",
    "lag_sequences",
    "forecast_weighted",
    "forecast_ar",
    "forecast_seasonal",
    "forecast_hybrid",
    "threshold_capacity",
    "policy_backtest",
    "compare_strategies",
    "threshold_sweep",
    "model_comparison",
    "full_experiment",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(10).selectExpr("sum(id)").collect()  # start the engine before the clock
    seconds = {}
    names = sys.argv[1:] or HEADLINE
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    out = {
        "metric": "total seconds over the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
