"""Metrics, histograms, baselines, LOF and streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from flowsift.operators import analysis, baselines, evaluate, outliers
from flowsift.plans import catalog
from flowsift.sources import results
from flowsift.streaming import score as streaming


def test_published_counts(spark):
    """Counts of a published run and the rates that follow from them."""
    counts = [(1, 1, 517), (1, 0, 336), (0, 1, 22), (0, 0, 125)]
    rows = [(h == 1, float(h), y, "m") for h, y, n in counts for _ in range(n)]
    df = spark.createDataFrame(rows, "is_anomaly boolean, score double, label int, model string")
    m = evaluate.classification_metrics(df).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (517, 336, 22, 125)
    assert m["accuracy"] == 0.642 and m["precision"] == pytest.approx(0.6060961313012896)
    assert m["recall"] == pytest.approx(0.9591836734693877) and m["f1_score"] == pytest.approx(0.742816091954023)
    matrix = {r["label"]: (r["predicted_normal"], r["predicted_anomaly"]) for r in evaluate.confusion_matrix(df).collect()}
    assert matrix == {0: (125, 336), 1: (22, 517)}


def test_auc_ties_and_one_class(spark):
    rows = [("a", 0.9, 1), ("a", 0.5, 1), ("a", 0.5, 0), ("a", 0.1, 0), ("b", 0.3, 1), ("b", 0.2, 1)]
    df = spark.createDataFrame(rows, "model string, score double, label int")
    got = {r["model"]: r["roc_auc"] for r in evaluate.roc_auc(df).collect()}
    assert got == {"a": 0.875, "b": 0.0}
    assert {r["roc_auc"] for r in evaluate.roc_auc(df.where("model = 'b'"), one_class=0.5).collect()} == {0.5}


def test_histogram_matches_numpy(spark):
    numbers = [0.0, 0.1, 0.5, 0.5, 0.99, 1.0]
    df = spark.createDataFrame([(v,) for v in numbers], "v double")
    got = [r["rows"] for r in analysis.histogram(df, F.col("v"), 4).orderBy("bin").collect()]
    assert got == list(np.histogram(numbers, bins=4)[0])


def planted(spark):
    rng = np.random.RandomState(1)
    points = np.vstack([rng.normal(0, 1, (1000, 3)), rng.normal(6, 1, (1000, 3)), rng.uniform(-15, 25, (100, 3))])
    rows = [(i, [float(v) for v in p], int(i >= 2000)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id bigint, features array<double>, label int")


def test_planted_outliers(spark):
    df = planted(spark)
    normal = df.where("label = 0")
    for model in (baselines.fit_iforest(normal, 0.1, trees=30), baselines.fit_ocsvm(normal, 0.1, rounds=3)):
        scored = model.score(df, ("id", "label")).persist()
        auc = evaluate.roc_auc(scored).first()["roc_auc"]
        flagged = scored.where("label = 0 and is_anomaly").count()
        assert auc > 0.97 and abs(flagged - 200) <= 2


def test_lof_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(outliers, "CELL_POINTS", 100)
    monkeypatch.setattr(outliers, "BLOCK_POINTS", 60)
    rng = np.random.RandomState(2)
    points = np.vstack([rng.normal(0, 1, (300, 3)), rng.uniform(-9, 9, (40, 3)), np.tile([[1.0, 2, 3]], (30, 1))])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id bigint, features array<double>")
    got = outliers.local_outlier_factor(df).toPandas().sort_values("id")
    distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    np.fill_diagonal(distance, np.inf)
    near = np.argsort(distance, axis=1, kind="stable")[:, :20]
    d = np.take_along_axis(distance, near, 1)
    lrd = 1 / (np.maximum(d[:, -1][near], d).mean(1) + 1e-10)
    lof = lrd[near].mean(1) / lrd
    assert np.allclose(got["score"], lof, rtol=1e-9)
    assert ((-lof < np.percentile(-lof, 10)) == got["is_anomaly"]).all()


def test_scaler_keeps_constant_columns(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 3.0)], "id bigint, a double, b double")
    out = baselines.fit_scaler(df, ["a", "b"]).transform(df).orderBy("id").collect()
    assert [(r["a"], r["b"]) for r in out] == [(0.0, -1.0), (0.0, 1.0)]


def test_stream_equals_batch(spark, tmp_path):
    d = catalog.detector(spark, SMALL)
    flows = catalog.test_flows(spark, SMALL).drop("split")
    total = flows.count()
    parts = flows.withColumn("part", F.ntile(3).over(__import__("pyspark").sql.Window.orderBy("id")))
    for i in (1, 2, 3):
        parts.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sinks = streaming.StreamSinks(str(tmp_path / "out"))
    streaming.score_stream(streaming.flow_stream(spark, str(tmp_path / "in"), flows.schema), d, sinks.root).awaitTermination()
    detail = streaming.read_output(spark, sinks.detail)
    assert detail.select("batch_id").distinct().count() == 3 and detail.count() == total
    batch = d.score(flows).select("id", F.col("is_anomaly").cast("int").alias("prediction"), "score")
    assert detail.select("id", "prediction", "score").exceptAll(batch).count() == 0
    flagged = streaming.read_output(spark, sinks.anomalies)
    assert flagged.count() == batch.where("prediction = 1").count()
    history = results.anomaly_history(flagged).first()
    assert history["total_anomalies"] == flagged.count()
    totals = streaming.running_metrics(streaming.read_output(spark, sinks.performance)).first()
    assert totals["flows_processed"] == total


def test_rate_per_minute_stream(spark, tmp_path):
    for i, times in enumerate([["10:00:05", "10:00:40"], ["10:01:00"], ["12:00:00"]]):
        rows = [(f"2024-01-01 {t}",) for t in times]
        spark.createDataFrame(rows, "timestamp string").coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
    stream = spark.readStream.schema("timestamp string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "a"))
    query = (
        streaming.anomalies_per_minute(stream).writeStream.format("memory").queryName("minutes").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    minutes = spark.table("minutes")
    got = [(str(r["minute"])[11:16], r["anomalies"]) for r in minutes.orderBy("minute").collect()]
    assert got == [("10:00", 2), ("10:01", 1), ("12:00", 1)]
    rates = [r["recent_rate"] for r in streaming.recent_rate(minutes).orderBy("minute").collect()]
    assert rates == [2.0, 1.5, 4 / 3]


def test_history_and_flow_table(spark, tmp_path):
    metrics = spark.createDataFrame(
        [("m", 0.5, 0.5, 0.5, 0.5, 0.5, 10, 5, 5)],
        "model string, accuracy double, precision double, recall double, f1_score double, roc_auc double, "
        "total_samples bigint, anomalies_detected bigint, true_anomalies bigint",
    )
    folder = str(tmp_path / "perf")
    assert results.run_history(spark, folder) is None
    for ts in ("r1", "r2"):
        results.append_performance(evaluate.run_performance(metrics, ts, 1, 2.0), folder)
    rows = results.run_history(spark, folder).collect()
    assert [r["run_ts"] for r in rows] == ["r1", "r2"] and rows[0]["flows_per_second"] == 5.0
    assert [r["run_ts"] for r in results.latest_run(spark, folder).collect()] == ["r2"]
    results.write_summary(metrics, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1
