"""Time the headline queries; prints one JSON line.

Each query starts without shared models, so its time includes all fitting.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "flow_features", "quantizer_params", "lsh_index", "score_flows", "score_flows_warm",
    "classification_metrics", "metrics_over_seeds", "iforest_score", "ocsvm_score", "lof_score", "stream_score", "feature_ablation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from flowsift.plans import catalog

    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the JVM's workers
    times: dict[str, float] = {}
    for name in HEADLINE:
        warm = name.endswith("_warm")
        if not warm:
            catalog.forget()
        query = catalog.QUERIES[name.removesuffix("_warm")]
        start = time.time()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    flows = catalog.test_flows(spark, sf_dir).count()
    print(json.dumps({
        "metric": "flow anomaly headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(cpus),
        "scored_flows_per_second": round(flows / times["score_flows_warm"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
