"""Result tables on disk: writers, and readers for the history of runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.operators.features import enrich


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written results, in the session's shared checkpoint folder.

    Only a local session without that setting uses a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="flowsift-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def write_summary(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A small result table (metrics per model or seed), one file."""
    writer = df.coalesce(1).write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_detail(detail: DataFrame, path: str) -> None:
    """Per-flow detail, one folder per model."""
    detail.write.mode("overwrite").partitionBy("model").parquet(path)


def append_performance(performance: DataFrame, path: str) -> None:
    """Add a run's metrics; one folder per run."""
    performance.write.mode("append").partitionBy("run_ts").parquet(path)


def write_anomalies(anomalies: DataFrame, path: str) -> None:
    anomalies.write.mode("append").parquet(path)


def replace_flow_table(flows: DataFrame, name: str, training: bool = True) -> DataFrame:
    """Drop and recreate a typed table of enriched flows; returns the stored table."""
    enrich(flows, training).write.mode("overwrite").saveAsTable(name)
    return flows.sparkSession.table(name)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err) or "UNABLE_TO_INFER_SCHEMA" in str(err):
            return None
        raise


def run_history(spark: SparkSession, path: str) -> DataFrame | None:
    """All runs and models in run order; None if nothing was written."""
    runs = _read(spark, path)
    if runs is None:
        return None
    return runs.select(F.col("run_ts").cast("string").alias("run_ts"), *[c for c in runs.columns if c != "run_ts"]).orderBy("run_ts", "model")


def latest_run(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of the run whose files are the newest."""
    runs = _read(spark, path)
    if runs is None:
        return None
    stamped = runs.select("*", F.col("_metadata.file_modification_time").alias("__written"))
    newest = stamped.agg(F.max_by("run_ts", "__written").alias("run_ts"))
    return runs.join(F.broadcast(newest), "run_ts")


def anomaly_history(anomalies: DataFrame) -> DataFrame:
    """Number of stored anomalies and the time of the last one, per model."""
    return anomalies.groupBy("detected_by_model").agg(
        F.count("*").alias("total_anomalies"), F.max("timestamp").alias("last_anomaly")
    )
