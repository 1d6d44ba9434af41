"""Three models behind one score: in batch, stored and read again, over seeds, and on a stream."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from flowsift.plans import catalog, suite
from flowsift.schema import IFOREST_MODEL, LSH_MODEL, OCSVM_MODEL
from flowsift.streaming.score import StreamSinks, read_output, replay_in_batches, score_stream

MODELS = {LSH_MODEL, IFOREST_MODEL, OCSVM_MODEL}


def rows(scored):
    """Scores by model and id; equal ones only differ in how floating sums were ordered."""
    return {(r["model"], r["id"]): (r["is_anomaly"], r["score"]) for r in scored.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)


def test_suite_scores_as_the_single_models_and_is_stored(spark, tmp_path):
    found = catalog._suite(spark, SMALL)
    flows = catalog.test_flows(spark, SMALL)
    want = rows(catalog.all_predictions(spark, SMALL))
    scored = found.score(flows, ("label", "proto"))
    assert scored.columns == ["id", "label", "proto", "model", "is_anomaly", "score"]
    got = rows(scored)
    assert len(got) == 3 * flows.count() and {m for m, _ in got} == MODELS
    same(got, want)
    found.save(str(tmp_path))
    same(rows(suite.FlowSuite.load(spark, str(tmp_path)).score(flows.repartition(5))), want)
    assert found.score(flows.limit(0), ("label",)).count() == 0


def test_null_cells_get_scores(spark):
    flows = catalog.test_flows(spark, SMALL).limit(3)
    empty = flows.select(*[F.lit(None).cast(flows.schema[c].dataType).alias(c) if c not in ("id", "label") else F.col(c) for c in flows.columns])
    got = catalog._suite(spark, SMALL).score(empty, ("label",)).collect()
    assert len(got) == 9 and all(np.isfinite(r["score"]) for r in got)


def test_suite_on_a_stream_in_batches(spark, tmp_path):
    found = catalog._suite(spark, SMALL)
    flows = catalog.test_flows(spark, SMALL).drop("split").orderBy("id").limit(60)
    stream = replay_in_batches(flows, str(tmp_path), 25)
    sinks = StreamSinks(str(tmp_path / "out"))
    score_stream(stream, found, sinks.root).awaitTermination()
    detail = read_output(spark, sinks.detail)
    sizes = {r["batch_id"]: r["count"] for r in detail.groupBy("batch_id").count().collect()}
    assert sorted(sizes.values()) == [30, 75, 75]
    want = found.score(flows, ("label",))
    totals = {r["model"]: r["n"] for r in read_output(spark, sinks.performance).groupBy("model").agg(F.sum(F.col("tp") + F.col("fp")).alias("n")).collect()}
    assert totals == {r["model"]: r["n"] for r in want.groupBy("model").agg(F.count_if("is_anomaly").alias("n")).collect()}


def test_metrics_of_each_seed(spark):
    train, test = catalog.normal_train(spark, SMALL), catalog.test_flows(spark, SMALL)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = suite.suite_metrics_per_seed(train, test, seeds=(3,), n_train=200, n_normal=60, n_anomaly=20).collect()
    assert {(r["seed"], r["model"]) for r in got} == {(3, m) for m in MODELS}
    assert all(r["tp"] + r["fp"] + r["fn"] + r["tn"] == r["total_samples"] for r in got)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
