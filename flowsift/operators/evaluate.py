"""Evaluation of predictions: rates, AUC, confusion matrix, summaries over seeds.

Predictions are long: one row per flow and model with ``is_anomaly``,
``score`` and ``label``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.functions.held import hold
from flowsift.operators.quantiles import cumulative

RATES = ("accuracy", "precision", "recall", "f1_score")
METRICS = (*RATES, "roc_auc")


def _share(top: Column, bottom: Column) -> Column:
    """Division with 0 for an empty denominator."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def classification_metrics(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Counts and rates per group; undefined rates are 0."""
    hit, true = F.col("is_anomaly"), F.col("label") == 1

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0))

    counts = predictions.groupBy(*by).agg(
        count(hit & true).alias("tp"), count(hit & ~true).alias("fp"),
        count(~hit & true).alias("fn"), count(~hit & ~true).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    return counts.select(
        *by, "tp", "fp", "fn", "tn",
        _share(tp + tn, total).alias("accuracy"),
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        total.alias("total_samples"),
        (tp + fp).alias("anomalies_detected"),
        (tp + fn).alias("true_anomalies"),
    )


def roc_auc(predictions: DataFrame, by: Sequence[str] = ("model",), one_class: float = 0.0) -> DataFrame:
    """Exact AUC, ties counted half; ``one_class`` where a class is missing.

    Rows shrink to one per distinct score before the running sum, which is
    bucketed when the distinct scores are many.
    """
    positive = F.when(F.col("label") == 1, 1).otherwise(0)
    counts = hold(predictions.groupBy(*by, F.col("score").alias("value")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    ))
    ranked = cumulative(counts, by, sums=("neg",))
    p, n = F.col("pos").cast("double"), F.col("neg").cast("double")
    sums = ranked.groupBy(*by).agg(
        F.sum(p * (F.col("neg_before").cast("double") + n * 0.5)).alias("wins"),
        F.sum(p).alias("positives"), F.sum(n).alias("negatives"),
    )
    return sums.select(
        *by,
        F.coalesce(F.try_divide("wins", F.col("positives") * F.col("negatives")), F.lit(one_class)).alias("roc_auc"),
    )


def all_metrics(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Counts, rates and AUC; groups are models or seeds, so the joined side is tiny."""
    auc = roc_auc(predictions, by)
    return classification_metrics(predictions, by).join(F.broadcast(auc), list(by))


def confusion_matrix(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    hit = F.col("is_anomaly").cast("int")
    return predictions.groupBy(*by, "label").agg(
        F.sum(1 - hit).alias("predicted_normal"), F.sum(hit).alias("predicted_anomaly")
    )


def over_seeds(per_seed: DataFrame, metrics: Sequence[str] = METRICS, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and population std of each metric over the seeds."""
    sums = []
    for m in metrics:
        sums += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return per_seed.groupBy(*by).agg(*sums)


def metric_long_summary(per_seed: DataFrame, metrics: Sequence[str] = METRICS, by: Sequence[str] = ("model",)) -> DataFrame:
    """The same summary as ``(by..., metric, mean, std)`` rows."""
    long = per_seed.unpivot([F.col(b) for b in by], [F.col(m) for m in metrics], "metric", "value")
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def anomaly_rate(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Detected flows, all flows and their ratio in percent."""
    hit = F.col("is_anomaly").cast("int")
    counts = predictions.groupBy(*by).agg(F.sum(hit).alias("anomalies_detected"), F.count("*").alias("total_samples"))
    return counts.withColumn("anomaly_rate", _share(F.col("anomalies_detected"), F.col("total_samples")) * 100)


def run_performance(metrics: DataFrame, run_ts: str, seed: int, total_time: float | None = None) -> DataFrame:
    """Metrics with the run's identity, flow count and throughput."""
    time = F.lit(total_time).cast("double")
    return metrics.select(
        "model",
        F.lit(run_ts).alias("run_ts"),
        F.lit(seed).alias("random_seed"),
        time.alias("total_time"),
        F.col("total_samples").alias("flows_processed"),
        F.when(time > 0, F.col("total_samples") / time).otherwise(0.0).alias("flows_per_second"),
        *METRICS, "total_samples", "anomalies_detected", "true_anomalies",
    )


def prediction_detail(predictions: DataFrame, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Per flow and model: prediction, score, label, and whether they agree."""
    hit = F.col("is_anomaly").cast("int")
    return predictions.select(
        *keep, "model", hit.alias("prediction"), "score",
        F.col("label").alias("true_label"), (hit == F.col("label")).alias("correct"),
    )


def anomalous_flows(predictions: DataFrame, detected_at: Column) -> DataFrame:
    """Flagged rows with detection fields appended."""
    columns = [c for c in predictions.columns if c not in ("model", "is_anomaly", "score")]
    return predictions.where("is_anomaly").select(
        *columns,
        F.col("score").alias("detection_score"),
        F.col("label").alias("true_label"),
        detected_at.alias("timestamp"),
        F.col("model").alias("detected_by_model"),
    )
