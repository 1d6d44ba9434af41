"""State of the scored stream: totals and minutes over restarts, late rows, gaps and repeated batches."""

import pytest
from pyspark.sql import functions as F

from flowsift.streaming import score, state


def performance(spark, folder, batch, tp, fp, fn, tn, model="m"):
    rows = spark.createDataFrame([(model, tp, fp, fn, tn, 0.5)], "model string, tp bigint, fp bigint, fn bigint, tn bigint, seconds double")
    rows.coalesce(1).write.mode("append").parquet(f"{folder}/batch_id={batch}")


def test_totals_over_a_restart(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    run = lambda: state.run_totals(spark, source, out, check).awaitTermination()
    for batch in range(3):
        performance(spark, source, batch, 1, 2, 3, 4)
    run()
    row = state.latest_totals(spark, out).first()
    assert (row.batches, row.flows_processed, row.anomalies_detected, row.seconds) == (3, 30, 9, 1.5)
    performance(spark, source, 2, 1, 2, 3, 4)  # the last batch, scored again after a failure
    performance(spark, source, 3, 10, 0, 0, 0)
    performance(spark, source, 3, 0, 0, 0, 5, model="other")
    run()
    rows = {r.model: r for r in state.latest_totals(spark, out).collect()}
    assert (rows["m"].batches, rows["m"].flows_processed, rows["m"].flows_per_second) == (4, 40, 20.0)
    assert rows["m"].accuracy == pytest.approx((13 + 12) / 40) and rows["other"].accuracy == 1.0


def minutes(spark, folder, batch, rows):
    table = spark.createDataFrame([("m", f"2024-01-01 {t}", n + 1, n) for t, n in rows], "model string, minute string, flows bigint, anomalies bigint")
    table.withColumn("minute", F.col("minute").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/batch_id={batch}")


def test_minutes_late_rows_gaps_and_restart(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    run = lambda: state.run_minutes(spark, source, out, check, lateness="10 minutes", last=3).awaitTermination()

    def closed():
        rows = state.closed_minutes(spark, out).withColumn("minute", F.date_format("minute", "HH:mm"))
        return sorted((r.minute, r.anomalies, round(r.recent_rate, 6)) for r in rows.collect())

    minutes(spark, source, 0, [("10:00", 2), ("10:01", 4), ("10:02", 0)])
    run()
    assert closed() == []  # nothing is ten minutes old
    minutes(spark, source, 1, [("10:01", 1), ("10:30", 6)])  # 10:01 is late but still open
    run()
    minutes(spark, source, 2, [("10:05", 99), ("12:00", 8)])  # 10:05 is behind the watermark
    run()
    minutes(spark, source, 2, [("12:00", 8)])  # the same batch again
    state.end_of_stream(spark, source, "2024-01-02 00:00:00")
    run()
    assert closed() == [("10:00", 2, 2.0), ("10:01", 5, 3.5), ("10:30", 6, round(13 / 3, 6)), ("12:00", 8, round(19 / 3, 6))]


def test_replay_in_counted_batches(spark, tmp_path):
    flows = spark.range(437).selectExpr("id", "id * 2 AS x").repartition(5)
    for stop, sizes in ((None, [100, 100, 100, 100, 37]), (250, [100, 100, 50]), (0, [])):
        folder = str(tmp_path / f"replay-{stop}")
        stream = score.replay_in_batches(flows, folder, 100, stop)
        seen = []
        stream.writeStream.foreachBatch(lambda b, i: seen.append([r.id for r in b.collect()])).option("checkpointLocation", f"{folder}/c").trigger(  # noqa: B023
            availableNow=True
        ).start().awaitTermination()
        assert sorted(map(len, seen), reverse=True) == sizes
        assert sorted(i for b in seen for i in b) == list(range(stop if stop is not None else 437))
        assert all(max(b) - min(b) == len(b) - 1 for b in seen)


def test_state_and_small_batches_take_few_partitions(spark, tmp_path):
    """The work of a trigger follows its rows, not the session's number of shuffle partitions."""
    from flowsift.operators import lsh
    from flowsift.schema import LSH_V2

    before = spark.conf.get(state.SHUFFLE)
    spark.conf.set(state.SHUFFLE, 40)
    try:
        source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
        for batch in range(2):
            performance(spark, source, batch, 1, 2, 3, 4)
        state.run_totals(spark, source, out, check).awaitTermination()
        assert state.latest_totals(spark, out).first().flows_processed == 20
        stores = [p for p in (tmp_path / "check" / "state" / "0").iterdir() if p.name.isdigit()]
        assert 0 < len(stores) <= state.STATE_PARTITIONS
        assert spark.conf.get(state.SHUFFLE) == "40"

        most = spark.sparkContext.defaultParallelism
        codes = spark.range(1000).selectExpr("id", "id * 7919 AS embedding")
        model = lsh.fit_lsh(codes, 1, LSH_V2)
        assert model.codes.count() == 1000 and model.codes.rdd.getNumPartitions() <= most
        model.release()

        class Scorer:
            def score(self, flows, keep):
                spread = flows.groupBy("id", "label").count().drop("count")
                return spread.selectExpr("id", "label", "'m' AS model", "id % 2 = 0 AS is_anomaly", "1.0 AS score")

        flows = spark.range(1000).selectExpr("id", "0 AS label")
        folder = str(tmp_path / "stream")
        flows.coalesce(1).write.parquet(f"{folder}/rows")
        stream = spark.readStream.schema(flows.schema).parquet(f"{folder}/rows")
        score.score_stream(stream, Scorer(), f"{folder}/out").awaitTermination()
        files = list((tmp_path / "stream" / "out" / "detail").rglob("part-*.parquet"))
        assert score.read_output(spark, f"{folder}/out/detail").count() == 1000 and 0 < len(files) <= most
        assert spark.conf.get(state.SHUFFLE) == "40"
    finally:
        spark.conf.set(state.SHUFFLE, before)
