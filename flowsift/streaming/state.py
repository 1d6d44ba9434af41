"""Running figures of a scored stream, kept in Spark's state store.

Both operators read what the scoring stream writes for each of its batches: a row per model
(``performance``) or per model and minute (``minutes``). So the rows that reach a model's state are few,
however many flows a batch has. A batch that was scored again after a failure is recognised by its
number and counts once. The state survives restarts: a new query on the same
checkpoint goes on where the last one ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHUFFLE = "spark.sql.shuffle.partitions"
# The keys are models, a few; every partition opens its stores and a Python worker in every trigger.
STATE_PARTITIONS = 4
COUNTS = ("tp", "fp", "fn", "tn")
PERFORMANCE = "model string, tp bigint, fp bigint, fn bigint, tn bigint, seconds double, batch_id bigint"
MINUTES = "model string, minute timestamp, flows bigint, anomalies bigint, batch_id bigint"
MINUTE_MS = 60_000


class RunningTotals(StatefulProcessor):
    """Totals of a model over all batches; a row whenever they change."""

    OUTPUT = (
        "model string, batches bigint, flows_processed bigint, anomalies_detected bigint, detection_share double, accuracy double, "
        "seconds double, flows_per_second double"
    )

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "last bigint, batches bigint, tp bigint, fp bigint, fn bigint, tn bigint, seconds double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, batches, tp, fp, fn, tn, seconds = self.totals.get() if self.totals.exists() else (-1, 0, 0, 0, 0, 0, 0.0)
        changed = False
        for row in pd.concat(rows).sort_values("batch_id").itertuples():
            if row.batch_id > last:  # batches are written one after another, so a smaller number was counted before
                last, batches, changed = int(row.batch_id), batches + 1, True
                tp, fp, fn, tn, seconds = tp + int(row.tp), fp + int(row.fp), fn + int(row.fn), tn + int(row.tn), seconds + float(row.seconds)
        if changed:
            self.totals.update((last, batches, tp, fp, fn, tn, seconds))
            total = tp + fp + fn + tn
            yield pd.DataFrame({
                "model": [key[0]], "batches": [batches], "flows_processed": [total], "anomalies_detected": [tp + fp],
                "detection_share": [(tp + fp) / total if total else 0.0], "accuracy": [(tp + tn) / total if total else 0.0],
                "seconds": [seconds], "flows_per_second": [total / seconds if seconds > 0 else 0.0],
            })

    def close(self) -> None:
        pass


class MinuteRing(StatefulProcessor):
    """Anomalies per minute and the mean of the last ten minutes that had any.

    A minute stays open until the watermark has passed its end; a timer then closes it. The counts of the last
    closed minutes are a ring in the state.
    """

    OUTPUT = "model string, minute timestamp, anomalies bigint, recent_rate double"

    def __init__(self, last: int = 10):
        self.last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "minute bigint", "anomalies bigint")
        self.ring = handle.getValueState("ring", "counts string")
        self.seen = handle.getValueState("seen", "batch bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seen = self.seen.get()[0] if self.seen.exists() else -1
        table = pd.concat(rows)
        table = table[(table["batch_id"] > seen) & (table["anomalies"] > 0)]
        if len(table):
            self.seen.update((int(table["batch_id"].max()),))
            minutes = table["minute"].astype("datetime64[ms, UTC]" if table["minute"].dt.tz else "datetime64[ms]").astype("int64")
            for minute, count in table["anomalies"].groupby(minutes).sum().items():
                at = (int(minute),)
                before = self.open.getValue(at)[0] if self.open.containsKey(at) else 0
                self.open.updateValue(at, (before + int(count),))
                if not before:
                    self.handle.registerTimer(int(minute) + MINUTE_MS)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        minute = expiredTimerInfo.getExpiryTimeInMs() - MINUTE_MS
        if not self.open.containsKey((minute,)):
            return
        # Timers expire in order of time, so the ring is that of the minutes before.
        count = self.open.getValue((minute,))[0]
        self.open.removeKey((minute,))
        ring = [int(x) for x in self.ring.get()[0].split(",")] if self.ring.exists() else []
        ring = [*ring, count][-self.last :]
        self.ring.update((",".join(map(str, ring)),))
        yield pd.DataFrame({
            "model": [key[0]], "minute": [pd.Timestamp(minute, unit="ms")], "anomalies": [count], "recent_rate": [sum(ring) / len(ring)],
        })

    def close(self) -> None:
        pass


def _source(spark: SparkSession, folder: str, schema: str, files: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def _run(states: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Each trigger's rows in a folder of their own, replaced if the trigger is run again."""

    def keep(rows: DataFrame, trigger: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/trigger={trigger}")

    spark = states.sparkSession
    before = {name: spark.conf.get(name) for name in (STORE, SHUFFLE)}
    spark.conf.set(STORE, ROCKS)  # a query keeps the settings it was started with
    spark.conf.set(SHUFFLE, min(STATE_PARTITIONS, int(before[SHUFFLE])))
    try:
        return (
            states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(keep).start()
        )
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def run_totals(spark: SparkSession, performance: str, folder: str, checkpoint: str, files: int = 1) -> StreamingQuery:
    """Totals per model after every ``files`` batches, for all batches written so far."""
    states = _source(spark, performance, PERFORMANCE, files).groupBy("model").transformWithStateInPandas(
        RunningTotals(), RunningTotals.OUTPUT, "Update", "None"
    )
    return _run(states, folder, checkpoint)


def run_minutes(spark: SparkSession, minutes: str, folder: str, checkpoint: str, lateness: str = "10 minutes", files: int = 1, last: int = 10) -> StreamingQuery:
    """Closed minutes per model. Rows later than ``lateness`` behind the latest minute are left out."""
    states = _source(spark, minutes, MINUTES, files).withWatermark("minute", lateness).groupBy("model").transformWithStateInPandas(
        MinuteRing(last), MinuteRing.OUTPUT, "Update", "EventTime"
    )
    return _run(states, folder, checkpoint)


def latest_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of each model."""
    rows = spark.read.parquet(folder)
    names = [c for c in rows.columns if c not in ("model", "trigger")]
    newest = rows.groupBy("model").agg(F.max_by(F.struct(*names), "trigger").alias("row"))
    return newest.select("model", "row.*")


def closed_minutes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop("trigger")


def end_of_stream(spark: SparkSession, minutes: str, after: str) -> None:
    """A row without anomalies at the time ``after``: it moves the watermark past all minutes before."""
    row = spark.range(1).select(
        F.lit("").alias("model"), F.lit(after).cast("timestamp").alias("minute"), F.lit(0).cast("bigint").alias("flows"), F.lit(0).cast("bigint").alias("anomalies"),
    )
    row.coalesce(1).write.mode("overwrite").parquet(f"{minutes}/batch_id={2**62}")
