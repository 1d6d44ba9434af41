"""Structured Streaming: scoring of flow streams and anomaly rates."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from flowsift.functions.held import held_tables, hold
from flowsift.functions.coerce import coerce_label
from flowsift.operators.evaluate import anomalous_flows, classification_metrics, prediction_detail
from flowsift.plans.detector import FlowDetector
from flowsift.schema import FLOW

# Flows of a micro-batch that one shuffle partition may hold; the session's number is the limit.
BATCH_PARTITION_ROWS = 10_000

def flow_stream(
    spark: SparkSession, path: str, schema: T.StructType = FLOW, files_per_trigger: int = 1
) -> DataFrame:
    """Replay of flow files; a trigger takes ``files_per_trigger`` new files.

    The limit is the back-pressure: a slow sink delays files, none is dropped.
    """
    return coerce_label(
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


@dataclass
class StreamSinks:
    """Folders of the streaming outputs."""

    root: str

    @property
    def detail(self) -> str:
        return f"{self.root}/detail"

    @property
    def anomalies(self) -> str:
        return f"{self.root}/anomalies"

    @property
    def performance(self) -> str:
        return f"{self.root}/performance"

    @property
    def minutes(self) -> str:
        return f"{self.root}/minutes"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"


def score_stream(stream: DataFrame, detector: FlowDetector, root: str, available_now: bool = True) -> StreamingQuery:
    """Score each micro-batch and write detail, anomalies and batch metrics.

    A batch's output goes to its own ``batch_id`` folder and replaces it when the
    batch is run again, so a restart leaves every flow exactly once.
    """
    sinks = StreamSinks(root)
    columns = [f.name for f in stream.schema if f.name != "id"]
    most = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        begun = time.monotonic()
        # A setting of the query's own session: cached tables keep all their partitions, so a small batch gets few.
        own = batch.sparkSession
        parts = max(own.sparkContext.defaultParallelism, -(-batch.count() // BATCH_PARTITION_ROWS))
        own.conf.set("spark.sql.shuffle.partitions", min(most, parts))
        with held_tables():
            scored = hold(detector.score(batch, tuple(columns)))
            kept = [c for c in ("id", "ts") if c in scored.columns]
            prediction_detail(scored, kept).write.mode("overwrite").parquet(f"{sinks.detail}/batch_id={batch_id}")
            anomalous_flows(scored, F.current_timestamp()).write.mode("overwrite").parquet(
                f"{sinks.anomalies}/batch_id={batch_id}"
            )
            if "ts" in kept:
                flows_per_minute(scored).coalesce(1).write.mode("overwrite").parquet(f"{sinks.minutes}/batch_id={batch_id}")
            # A few rows: one file a batch, so that a batch is read as a whole.
            seconds = F.lit(time.monotonic() - begun)
            classification_metrics(scored).coalesce(1).withColumn("seconds", seconds).write.mode("overwrite").parquet(f"{sinks.performance}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", sinks.checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def flows_per_minute(scored: DataFrame) -> DataFrame:
    """Flows and anomalies of each model and event-time minute."""
    minute = F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("minute")
    return scored.groupBy("model", minute).agg(F.count("*").alias("flows"), F.sum(F.col("is_anomaly").cast("bigint")).alias("anomalies"))


def replay_in_batches(flows: DataFrame, folder: str, rows: int = 100, stop_after: int | None = None) -> DataFrame:
    """A stream that gives ``rows`` flows a micro-batch and ends after ``stop_after`` flows (all, if null).

    The flows are written once, ``rows`` to a file, and a trigger takes one file: the limit is counted, a restart goes
    on behind the last complete batch, and only the last batch may be smaller.
    """
    spark = flows.sparkSession
    chosen = flows if stop_after is None else flows.orderBy("id").limit(stop_after)
    # Runs of ``rows`` flows in order of id; the numbers come from counts of range partitions, not from one task.
    parts = chosen.repartitionByRange("id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id())
    numbered = parts.withColumn("place", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("bigint"), 33))
    numbered.write.mode("overwrite").parquet(f"{folder}/numbered")
    stored = spark.read.schema(numbered.schema).parquet(f"{folder}/numbered")
    sizes = stored.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = F.floor((F.col("place") + F.col("before")) / rows)
    placed = stored.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").withColumn("run", run)
    # A run's flows meet in one partition of the shuffle; files are cut where the run ends.
    ordered = placed.repartition("run").sortWithinPartitions("run", "id")
    ordered.drop("part", "place", "before").write.mode("overwrite").partitionBy("run").parquet(f"{folder}/batches")
    return spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/batches")


def read_output(spark: SparkSession, folder: str) -> DataFrame:
    """All batches of one streaming output (``batch_id`` is a partition column)."""
    return spark.read.parquet(folder)


def running_metrics(batches: DataFrame) -> DataFrame:
    """Totals and rates per model over the batches written so far."""
    counts = batches.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    detected = F.col("tp") + F.col("fp")
    return counts.select(
        "model", total.alias("flows_processed"), detected.alias("anomalies_detected"),
        F.coalesce(F.try_divide(detected.cast("double"), total.cast("double")), F.lit(0.0)).alias("detection_share"),
        F.coalesce(F.try_divide((F.col("tp") + F.col("tn")).cast("double"), total.cast("double")), F.lit(0.0)).alias("accuracy"),
    )


def anomalies_per_minute(stream: DataFrame, lateness: str = "10 minutes", time: str = "timestamp") -> DataFrame:
    """Anomalies per event-time minute of a stream (or table) of flagged flows."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    if stream.isStreaming:
        timed = timed.withWatermark(time, lateness)
    return timed.groupBy(F.window(time, "1 minute").alias("w")).agg(F.count("*").alias("anomalies")).select(
        F.col("w.start").alias("minute"), "anomalies"
    )


def recent_rate(minutes: DataFrame, last: int = 10) -> DataFrame:
    """Mean of the last ten per-minute counts; input is one row per minute."""
    order = Window.orderBy("minute").rowsBetween(-(last - 1), Window.currentRow)
    return minutes.select("minute", "anomalies", F.avg("anomalies").over(order).alias("recent_rate"))
