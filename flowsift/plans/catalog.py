"""Registered queries: one per operator, each over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.functions.coerce import coerce_label, double_or, protocol_code, read_long
from flowsift.functions.held import held_tables, hold
from flowsift.functions.numeric import grid, hamming_words, sign_code
from flowsift.operators import analysis, baselines, evaluate, lsh
from flowsift.operators import features as feats
from flowsift.operators.hamming_search import exact_knn, index_recall
from flowsift.operators.outliers import local_outlier_factor
from flowsift.operators.quantizer import quantizer_params, quantizer_report, top_bits
from flowsift.operators.sampling import sample_n, stratified_sample, with_label
from flowsift.operators.verdict import settled, with_verdict
from flowsift.plans import experiments
from flowsift.plans.detector import FlowCoder, FlowDetector, fit_flow_coder, fit_flow_detector, fit_flow_detector_v1
from flowsift.plans.suite import FlowSuite
from flowsift.schema import FEATURES, LSH_V1, LSH_V2, OPTIMIZED_FEATURES, QUANTIZER_V1, QUANTIZER_V2, VECTOR8
from flowsift.sources import results
from flowsift.sources.flows import event_flows, flows_from_events, read_flows
from flowsift.streaming import state
from flowsift.streaming.score import StreamSinks, read_output, replay_in_batches, score_stream

Query = Callable[[SparkSession, str], DataFrame]
SEED = 42
_REAL = {
    "duration", "mean_packet_size", "bytes_per_packet", "bytes_per_second", "packets_per_second",
    "src_bytes_ratio", "src_packets_ratio", "src_load", "dst_load", "load_ratio",
}

# Fitted models and scored tables per session and folder, shared by the queries.
_shared: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _shared:
        _shared[key] = make()
    return _shared[key]


def _kept(make: Callable[[], DataFrame]) -> DataFrame:
    """A cached result, without the tables that were cached on the way to it."""
    with held_tables():
        out = make().persist()
        out.count()
    return out


def forget() -> None:
    """Drop shared models, so the next query fits its own."""
    for value in _shared.values():
        if isinstance(value, DataFrame):
            value.unpersist()
        elif hasattr(value, "release"):
            value.release()
    _shared.clear()


def normal_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_flows(spark, sf_dir, split="train", label=0)


def test_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_flows(spark, sf_dir, split="test")


def coder(spark: SparkSession, sf_dir: str, version: str = "v2") -> FlowCoder:
    """Vocabularies and bins, for queries that need no index."""
    spec = QUANTIZER_V2 if version == "v2" else QUANTIZER_V1
    return _once(spark, sf_dir, f"coder-{version}", lambda: fit_flow_coder(normal_train(spark, sf_dir), spec, version == "v2"))


def detector(spark: SparkSession, sf_dir: str, version: str = "v2") -> FlowDetector:
    fit = fit_flow_detector if version == "v2" else fit_flow_detector_v1
    return _once(
        spark, sf_dir, f"detector-{version}",
        lambda: fit(normal_train(spark, sf_dir), SEED, coder=coder(spark, sf_dir, version)),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored test flows with label and time."""
    return _once(
        spark, sf_dir, "predictions",
        lambda: _kept(lambda: detector(spark, sf_dir).score(test_flows(spark, sf_dir), ("label", "ts"))),
    )


def seed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        spark, sf_dir, "seed_metrics",
        lambda: _kept(lambda: experiments.metrics_per_seed(
            experiments.predict_over_seeds(normal_train(spark, sf_dir), test_flows(spark, sf_dir))
        )),
    )


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        spark, sf_dir, "ablation",
        lambda: _kept(lambda: experiments.feature_ablation(
            coder(spark, sf_dir, "v1"), normal_train(spark, sf_dir), test_flows(spark, sf_dir)
        )),
    )


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Put float columns on the output grid."""
    return df.select(*[grid(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


def _features(spark: SparkSession, sf_dir: str, optimized: bool = False) -> DataFrame:
    return feats.flow_features(event_flows(spark, sf_dir), optimized=optimized)


def _train_features(spark: SparkSession, sf_dir: str, version: str) -> DataFrame:
    """Training features with their vocabularies alone: no bins, no index."""
    normal, optimized = normal_train(spark, sf_dir), version == "v2"
    learned = _once(
        spark, sf_dir, f"vocabularies-{version}",
        lambda: feats.Vocabularies.learn(normal, with_state=not optimized).freeze(),
    )
    return feats.flow_features(normal, learned, optimized=optimized)


def _params_rows(params: DataFrame) -> DataFrame:
    levels = F.coalesce("thresholds", "categories")
    return params.select(
        "feature", "type", "bits", "n_values", grid(F.col("min_val")).alias("min_val"),
        grid(F.col("max_val")).alias("max_val"), F.posexplode(levels).alias("i", "level"),
    ).withColumn("level", grid(F.col("level")))


def _codes(spark: SparkSession, sf_dir: str, version: str) -> DataFrame:
    """Codes of normal training flows and test flows."""
    d = coder(spark, sf_dir, version)
    train, test = d.codes(normal_train(spark, sf_dir)), d.codes(test_flows(spark, sf_dir))
    return train.unionByName(test).select("id", "embedding")


def _queries_hashed(spark: SparkSession, sf_dir: str) -> tuple[lsh.LshModel, DataFrame]:
    d = detector(spark, sf_dir)
    codes = d.codes(test_flows(spark, sf_dir)).select("run", "embedding").distinct()
    return d.lsh, d.lsh.hash(codes)


# ------------------------------------------------------------------ queries


def flow_scan(spark, sf_dir):
    """The flows stored as a table and scanned with a fixed schema."""
    flows, folder = event_flows(spark, sf_dir), results.work_folder(spark, "flows")
    flows.write.parquet(folder)
    return rounded(read_flows(spark, folder, schema=flows.schema), "dur", "rate", "sload", "dload")


def prediction_detail(spark, sf_dir):
    """Written per model and read back."""
    folder = results.work_folder(spark, "detail")
    results.write_detail(evaluate.prediction_detail(predictions(spark, sf_dir)), folder)
    return rounded(spark.read.parquet(folder), "score")


def _stored_anomalies(spark, sf_dir):
    """Flagged flows appended to a stored table, and read from it."""
    folder = results.work_folder(spark, "anomalies")
    d = detector(spark, sf_dir)
    keep = ("proto", "service", "state", "sbytes", "dbytes", "spkts", "dpkts")
    scored = d.score(test_flows(spark, sf_dir), ("label", "ts", *keep))
    results.write_anomalies(evaluate.anomalous_flows(scored, F.col("ts")).drop("label", "ts"), folder)
    return spark.read.parquet(folder)


def anomalous_flows(spark, sf_dir):
    return rounded(_stored_anomalies(spark, sf_dir), "detection_score")


def run_performance(spark, sf_dir):
    metrics = evaluate.all_metrics(predictions(spark, sf_dir))
    out = evaluate.run_performance(metrics, "run-42", SEED).drop("total_time", "flows_per_second")
    return rounded(out, *evaluate.METRICS)


def enriched_flow_table(spark, sf_dir):
    flows = event_flows(spark, sf_dir)
    train = feats.enrich(flows.where("split = 'train'"), True)
    test = feats.enrich(flows.where("split = 'test'"), False)
    out = rounded(train.unionByName(test), "dur", "rate")
    # Its JSON text, without the two floats that engines print differently.
    out = out.withColumn("flow_description", F.regexp_replace("flow_description", '"(dur|rate)":[^,}]*,', ""))
    out = out.withColumn("flow_description", F.regexp_replace("flow_description", '"[0-9a-f]{32}"', '"hashed"'))
    # The id 0 is falsy, so that record is named by its content.
    return out.withColumn("flow_id", F.when(F.length("flow_id") == 32, "hashed").otherwise(F.col("flow_id")))


def coerce_double(spark, sf_dir):
    return event_flows(spark, sf_dir).select("id", double_or(F.col("smean"), -1.0).alias("value"))


def coerce_int(spark, sf_dir):
    flows = event_flows(spark, sf_dir)
    return flows.select("id", read_long(flows, "smean").alias("value"), read_long(flows, "dur").alias("whole_seconds"))


def coerce_labels(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.when(F.col("event_type") == "error", "1").when(F.col("event_type") == "click", "0.0").otherwise("none")
    return coerce_label(events.select(F.col("event_id").alias("id"), text.alias("label")))


def protocols(spark, sf_dir):
    flows = event_flows(spark, sf_dir)
    return flows.select("id", protocol_code(flows).alias("protocol"))


def service_vocab(spark, sf_dir):
    flows = event_flows(spark, sf_dir)
    return feats.vocabulary(flows, feats.service_text(flows))


def state_vocab(spark, sf_dir):
    flows = event_flows(spark, sf_dir)
    return feats.vocabulary(flows, feats.state_text(flows))


def service_encode(spark, sf_dir):
    flows = event_flows(spark, sf_dir)
    return feats.Vocabularies.learn(flows).encode(flows).select("id", "service_encoded", "state_encoded")


def flow_features(spark, sf_dir):
    return rounded(_features(spark, sf_dir), *_REAL)


def flow_features_optimized(spark, sf_dir):
    return rounded(_features(spark, sf_dir, True), *_REAL)


def feature_matrix(spark, sf_dir):
    matrix = feats.feature_matrix(_features(spark, sf_dir, True))
    return rounded(matrix.select("id", F.posexplode("features").alias("pos", "value")), "value")


def feature_long(spark, sf_dir):
    return rounded(feats.feature_long(_features(spark, sf_dir, True), OPTIMIZED_FEATURES), "value")


def flow_vector8(spark, sf_dir):
    return rounded(feats.flow_vector8(event_flows(spark, sf_dir)), "dur", "rate")


def content_id(spark, sf_dir):
    """Ids of whole records: the own id, and the hash that a record without one gets."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        "event_id", feats.content_id(events, id_column="event_id").alias("own_id"), feats.content_id(events, id_column="none").alias("content_hash")
    )


def flow_match_key(spark, sf_dir):
    flows = event_flows(spark, sf_dir)
    return flows.select("id", feats.flow_match_key(flows).alias("match_key"))


def normal_flows(spark, sf_dir):
    return with_label(event_flows(spark, sf_dir), 0).select("id", "label")


def sample_normal(spark, sf_dir):
    return sample_n(normal_train(spark, sf_dir).select("id", "label"), 3000, SEED)


def stratified_test(spark, sf_dir):
    return stratified_sample(test_flows(spark, sf_dir).select("id", "label"), {0: 800, 1: 400}, SEED)


def stream_sample(spark, sf_dir):
    return sample_n(test_flows(spark, sf_dir).select("id", "label"), 1000, SEED)


def embedding_diversity(spark, sf_dir):
    codes = lsh.distinct_codes(coder(spark, sf_dir).codes(normal_train(spark, sf_dir)))
    return codes.agg(F.sum("n_flows").alias("flows"), F.count("*").alias("codes"))


def params_v2(spark, sf_dir):
    return _params_rows(quantizer_params(_train_features(spark, sf_dir, "v2"), QUANTIZER_V2))


def params_v1(spark, sf_dir):
    return _params_rows(quantizer_params(_train_features(spark, sf_dir, "v1"), QUANTIZER_V1))


def report(spark, sf_dir):
    return quantizer_report(quantizer_params(_train_features(spark, sf_dir, "v1"), QUANTIZER_V1))


def widest_features(spark, sf_dir):
    return top_bits(quantizer_params(_train_features(spark, sf_dir, "v1"), QUANTIZER_V1))


def quantized_bins(spark, sf_dir):
    d = coder(spark, sf_dir)
    binned = d.quantizer.with_bins(d.features(test_flows(spark, sf_dir)))
    names = [F.col(f"{n}_bin").alias(n) for n in QUANTIZER_V2.priority]
    return binned.select("id", *names).unpivot("id", [F.col(n) for n in QUANTIZER_V2.priority], "feature", "bin")


def flow_embedding(spark, sf_dir):
    return _codes(spark, sf_dir, "v2")


def flow_embedding_v1(spark, sf_dir):
    return _codes(spark, sf_dir, "v1")


def vector_sign_code(spark, sf_dir):
    """Words of the codes, one row each."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.select("vec_id", F.posexplode(sign_code(F.col("embedding"))).alias("word", "code"))


def lsh_keys(spark, sf_dir):
    codes = coder(spark, sf_dir).codes(test_flows(spark, sf_dir)).select("run", "embedding").distinct()
    queries = lsh.hash_codes(codes, {0: lsh.HashFamily.draw(SEED, LSH_V2)})
    return lsh.explode_keys(queries, LSH_V2).select("embedding", "table_idx", "hash_key")


def lsh_index(spark, sf_dir):
    codes = coder(spark, sf_dir).codes(normal_train(spark, sf_dir))
    index = lsh.build_index(codes, {0: lsh.HashFamily.draw(SEED, LSH_V2)}, LSH_V2)
    return index.select("table_idx", "hash_key", "embedding", "n_flows", "first_pos")


def hamming_distance(spark, sf_dir):
    """Distance of each vector's sign code to the first vector of its class."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    codes = vectors.select("vec_id", "label", sign_code(F.col("embedding")).alias("code"))
    first = codes.groupBy("label").agg(F.min_by("code", "vec_id").alias("first_code"))
    # one row per class label; Spark picks the join from its run-time size
    return codes.join(first, "label").select("vec_id", hamming_words(F.col("code"), F.col("first_code")).cast("int").alias("distance"))


def _stats(spark, sf_dir, version, spec):
    codes = coder(spark, sf_dir, version).codes(normal_train(spark, sf_dir))
    return lsh.distance_stats(lsh.distance_sample(codes, SEED, spec), spec)


def distance_stats(spark, sf_dir):
    names = ["mean", "std", "p10", "p25", "p50", "p75", "p90"]
    return rounded(_stats(spark, sf_dir, "v2", LSH_V2).select(*names), *names)


def distance_stats_v1(spark, sf_dir):
    return rounded(_stats(spark, sf_dir, "v1", LSH_V1).select("mean", "std"), "mean", "std")


def anomaly_threshold(spark, sf_dir):
    return rounded(lsh.with_threshold(_stats(spark, sf_dir, "v2", LSH_V2), LSH_V2).select("threshold"), "threshold")


def lsh_candidates(spark, sf_dir):
    model, queries = _queries_hashed(spark, sf_dir)
    found = lsh.nearest_mates(model, queries, LSH_V2.neighbours)
    return found.select(F.col("query").alias("embedding"), "candidates")


def lsh_probe(spark, sf_dir):
    """Near-bucket candidates of the codes without bucket-mates."""
    model, queries = _queries_hashed(spark, sf_dir)
    met = lsh.nearest_mates(model, queries, LSH_V2.neighbours)
    missed = hold(queries.join(met.select("run", F.col("query").alias("embedding")), ["run", "embedding"], "left_anti"))  # read twice
    probed = lsh.nearest(lsh.probe_pairs(model, missed), LSH_V2.neighbours)
    probed = probed.select(F.col("query").alias("embedding"), "candidates")
    return missed.select("embedding").join(probed, "embedding", "left").select(
        "embedding", F.coalesce("candidates", F.lit(0)).cast("bigint").alias("candidates")
    )


def lsh_knn(spark, sf_dir):
    d = detector(spark, sf_dir)
    return rounded(lsh.knn(d.lsh, d.codes(test_flows(spark, sf_dir))).drop("run"), "avg_distance")


def hamming_knn_exact(spark, sf_dir):
    """The true nearest training codes of every test code."""
    d = coder(spark, sf_dir)
    queries, known = d.codes(test_flows(spark, sf_dir)), d.codes(normal_train(spark, sf_dir))
    return rounded(exact_knn(queries, known, LSH_V2.neighbours), "avg_distance")


def lsh_recall(spark, sf_dir):
    model, queries = _queries_hashed(spark, sf_dir)
    return rounded(index_recall(model, queries, LSH_V2.neighbours), "recall")


def _verdict(spark, sf_dir, version):
    d = detector(spark, sf_dir, version)
    summary = lsh.knn(d.lsh, d.codes(test_flows(spark, sf_dir)), settled(d.lsh.spec))
    return rounded(with_verdict(summary, d.lsh).select("embedding", "is_anomaly", "score"), "score")


def lsh_verdict(spark, sf_dir):
    return _verdict(spark, sf_dir, "v2")


def lsh_verdict_v1(spark, sf_dir):
    return _verdict(spark, sf_dir, "v1")


def score_flows(spark, sf_dir):
    return rounded(detector(spark, sf_dir).score(test_flows(spark, sf_dir)), "score")


def lsh_index_stats(spark, sf_dir):
    return rounded(lsh.index_stats(detector(spark, sf_dir).lsh.index, LSH_V2), "mean_bucket", "skew")


def classification_metrics(spark, sf_dir):
    return rounded(evaluate.classification_metrics(predictions(spark, sf_dir)), *evaluate.RATES)


def roc_auc(spark, sf_dir):
    return rounded(evaluate.roc_auc(predictions(spark, sf_dir)), "roc_auc")


def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(predictions(spark, sf_dir))


def anomaly_rate(spark, sf_dir):
    return rounded(evaluate.anomaly_rate(predictions(spark, sf_dir)), "anomaly_rate")


def metrics_over_seeds(spark, sf_dir):
    names = [f"{m}_{s}" for m in evaluate.METRICS for s in ("mean", "std")]
    return rounded(evaluate.over_seeds(seed_metrics(spark, sf_dir)), *names)


def metric_long_summary(spark, sf_dir):
    return rounded(evaluate.metric_long_summary(seed_metrics(spark, sf_dir)), "mean", "std")


def feature_profile(spark, sf_dir):
    # Sums of large loads differ between engines in their last digits: two decimals.
    profile = rounded(analysis.feature_profile(_features(spark, sf_dir), FEATURES), "min", "max", "zero_ratio")
    return profile.withColumn("mean", grid(F.col("mean"), 1e2)).withColumn("std", grid(F.col("std"), 1e2))


def feature_corr_matrix(spark, sf_dir):
    return rounded(analysis.feature_corr_matrix(_features(spark, sf_dir), FEATURES), "correlation")


def redundant_pairs(spark, sf_dir):
    matrix = analysis.feature_corr_matrix(_features(spark, sf_dir), FEATURES)
    return rounded(analysis.redundant_pairs(matrix, FEATURES), "correlation")


def feature_code_corr(spark, sf_dir):
    d = coder(spark, sf_dir, "v1")
    keep = ("id", *FEATURES)
    coded = d.quantizer.encode(d.features(normal_train(spark, sf_dir)), keep=keep)
    return rounded(analysis.feature_code_corr(coded, FEATURES), "correlation")


def embedding_histogram(spark, sf_dir):
    codes = coder(spark, sf_dir, "v1").codes(normal_train(spark, sf_dir))
    return analysis.histogram(codes, F.col("embedding"), 50)


def feature_ablation(spark, sf_dir):
    return rounded(ablation(spark, sf_dir), "f1_score", "f1_drop", "relative_drop")


def top_features(spark, sf_dir):
    return rounded(analysis.top_features(ablation(spark, sf_dir)), "f1_score", "f1_drop", "relative_drop")


def anomaly_rate_per_minute(spark, sf_dir):
    """Through the stream of closed minutes; a last row after all others closes the open ones."""
    sinks, folder = _stream_output(spark, sf_dir), results.work_folder(spark, "minutes")
    run = lambda: state.run_minutes(spark, sinks.minutes, f"{folder}/rows", f"{folder}/checkpoint", lateness="3650 days").awaitTermination()
    run()
    state.end_of_stream(spark, sinks.minutes, "2100-01-01 00:00:00")
    run()
    minutes = state.closed_minutes(spark, f"{folder}/rows").select("minute", "anomalies", "recent_rate")
    return rounded(minutes.withColumn("minute", F.col("minute").cast("timestamp_ntz")), "recent_rate")


def anomaly_history(spark, sf_dir):
    return results.anomaly_history(_stored_anomalies(spark, sf_dir))


# ------------------------------------------------- baselines and all models


def _scaled(spark, sf_dir):
    """Scaler learned on normal training flows, and both scaled feature tables."""
    d = coder(spark, sf_dir)
    train = d.features(normal_train(spark, sf_dir))
    scaler = baselines.fit_scaler(train, sorted(OPTIMIZED_FEATURES))
    test = d.features(test_flows(spark, sf_dir), ("id", "label"))
    return scaler, scaler.vectors(train), scaler.vectors(test, ("id", "label"))


def _forest(spark, sf_dir):
    return _once(spark, sf_dir, "forest", lambda: baselines.fit_iforest(_scaled(spark, sf_dir)[1], 0.15, seed=SEED))


def _svm(spark, sf_dir):
    return _once(spark, sf_dir, "svm", lambda: baselines.fit_ocsvm(_scaled(spark, sf_dir)[1], 0.15, seed=SEED))


def scaled_features(spark, sf_dir):
    features = _features(spark, sf_dir, True)
    return rounded(baselines.fit_scaler(features, OPTIMIZED_FEATURES).transform(features), *OPTIMIZED_FEATURES)


def _pca(spark, sf_dir):
    train = feats.flow_vector8(normal_train(spark, sf_dir))
    scaler = baselines.fit_scaler(train, VECTOR8)
    return scaler, baselines.fit_pca(scaler.transform(train), VECTOR8)


def pca_variance(spark, sf_dir):
    _, model = _pca(spark, sf_dir)
    rows = [(i, float(v)) for i, v in enumerate(model.explainedVariance.toArray())]
    return rounded(spark.createDataFrame(rows, "component int, explained double"), "explained")


def _projected(spark, sf_dir):
    scaler, model = _pca(spark, sf_dir)
    scaled = scaler.transform(feats.flow_vector8(test_flows(spark, sf_dir)))
    return baselines.pca_project(model, scaled, VECTOR8)


def pca_project(spark, sf_dir):
    return rounded(_projected(spark, sf_dir).select("id", F.posexplode("features").alias("component", "value")), "value")


def iforest_fit(spark, sf_dir):
    nodes = _forest(spark, sf_dir).nodes
    return spark.createDataFrame(nodes, baselines._TREE_SCHEMA).groupBy("tree").agg(
        F.count("*").alias("nodes"), F.max("depth").alias("depth"), F.max("size").alias("rows")
    )


def iforest_score(spark, sf_dir):
    return rounded(_forest(spark, sf_dir).score(_scaled(spark, sf_dir)[2]), "score")


def ocsvm_score(spark, sf_dir):
    return rounded(_svm(spark, sf_dir).score(_scaled(spark, sf_dir)[2]), "score")


def lof_score(spark, sf_dir):
    return rounded(local_outlier_factor(_projected(spark, sf_dir)), "score")


def all_predictions(spark, sf_dir):
    """Long predictions of the three models on the test flows."""
    test = _scaled(spark, sf_dir)[2]
    keep = ("id", "label")
    out = predictions(spark, sf_dir).select(*keep, "model", "is_anomaly", "score")
    return out.unionByName(_forest(spark, sf_dir).score(test, keep)).unionByName(_svm(spark, sf_dir).score(test, keep))


# ------------------------------------------------------- streaming and history


def _stream_output(spark, sf_dir):
    """Score the test flows as a stream of files; returns the output folders."""

    def run():
        events = (
            spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema)
            .option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
        )
        stream = flows_from_events(events).where("split = 'test'").drop("split")
        sinks = StreamSinks(results.work_folder(spark, "stream"))
        score_stream(stream, detector(spark, sf_dir), sinks.root).awaitTermination()
        return sinks

    return _once(spark, sf_dir, "stream", run)


def stream_score(spark, sf_dir):
    detail = read_output(spark, _stream_output(spark, sf_dir).detail)
    return rounded(detail.drop("batch_id", "ts"), "score")


def stream_metrics(spark, sf_dir):
    """Totals out of the state store, after all batches of the scored stream."""
    sinks, folder = _stream_output(spark, sf_dir), results.work_folder(spark, "totals")
    state.run_totals(spark, sinks.performance, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    totals = state.latest_totals(spark, f"{folder}/rows").drop("batches", "seconds", "flows_per_second")
    return rounded(totals, "detection_share", "accuracy")


def _replay(spark, sf_dir, model) -> StreamSinks:
    """The sampled stream of 1,000 test flows, scored in micro-batches of 100; the output folders."""
    folder = results.work_folder(spark, "replay")
    flows = test_flows(spark, sf_dir).drop("split")
    chosen = sample_n(flows.select("id"), 1000, SEED).select("id")
    stream = replay_in_batches(flows.join(F.broadcast(chosen), "id", "left_semi").select(*flows.columns), folder, 100)
    sinks = StreamSinks(f"{folder}/out")
    score_stream(stream, model, sinks.root).awaitTermination()
    return sinks


def stream_replay(spark, sf_dir):
    """Flows of the sampled stream by batch size and verdict."""
    detail = read_output(spark, _replay(spark, sf_dir, detector(spark, sf_dir)).detail)
    sizes = detail.groupBy("batch_id").agg(F.count("*").alias("batch_rows"))
    return rounded(detail.join(F.broadcast(sizes), "batch_id").drop("batch_id", "ts"), "score")


def _suite(spark, sf_dir) -> FlowSuite:
    return _once(
        spark, sf_dir, "suite",
        lambda: FlowSuite(detector(spark, sf_dir), _scaled(spark, sf_dir)[0], _forest(spark, sf_dir), _svm(spark, sf_dir)),
    )


def suite_metrics(spark, sf_dir):
    """Counts, rates and AUC of all three models on the test flows."""
    with held_tables():
        out = evaluate.all_metrics(_suite(spark, sf_dir).score(test_flows(spark, sf_dir), ("label",))).persist()
        out.count()
    return rounded(out, *evaluate.METRICS)


def suite_stream(spark, sf_dir):
    """Totals of all three models over the sampled stream, out of the state store."""
    sinks, folder = _replay(spark, sf_dir, _suite(spark, sf_dir)), results.work_folder(spark, "totals")
    state.run_totals(spark, sinks.performance, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    totals = state.latest_totals(spark, f"{folder}/rows").drop("seconds", "flows_per_second")
    return rounded(totals, "detection_share", "accuracy")


def run_history(spark, sf_dir):
    folder = results.work_folder(spark, "performance")
    metrics = evaluate.all_metrics(predictions(spark, sf_dir))
    results.append_performance(evaluate.run_performance(metrics, "run-42", SEED), folder)
    out = results.run_history(spark, folder).drop("total_time", "flows_per_second")
    return rounded(out, *evaluate.METRICS)


QUERIES: dict[str, Query] = {
    "scaled_features": scaled_features,
    "pca_variance": pca_variance,
    "pca_project": pca_project,
    "iforest_fit": iforest_fit,
    "iforest_score": iforest_score,
    "ocsvm_score": ocsvm_score,
    "lof_score": lof_score,
    "all_predictions": all_predictions,
    "stream_score": stream_score,
    "stream_metrics": stream_metrics,
    "stream_replay": stream_replay,
    "suite_metrics": suite_metrics,
    "suite_stream": suite_stream,
    "run_history": run_history,
    "flow_scan": flow_scan,
    "prediction_detail": prediction_detail,
    "anomalous_flows": anomalous_flows,
    "run_performance": run_performance,
    "enriched_flow_table": enriched_flow_table,
    "anomaly_history": anomaly_history,
    "coerce_double": coerce_double,
    "coerce_int": coerce_int,
    "coerce_label": coerce_labels,
    "protocol_code": protocols,
    "service_vocab": service_vocab,
    "state_vocab": state_vocab,
    "service_encode": service_encode,
    "flow_features": flow_features,
    "flow_features_optimized": flow_features_optimized,
    "feature_matrix": feature_matrix,
    "feature_long": feature_long,
    "flow_vector8": flow_vector8,
    "content_id": content_id,
    "flow_match_key": flow_match_key,
    "normal_flows": normal_flows,
    "sample_normal": sample_normal,
    "stratified_test": stratified_test,
    "stream_sample": stream_sample,
    "embedding_diversity": embedding_diversity,
    "quantizer_params": params_v2,
    "quantizer_params_v1": params_v1,
    "quantizer_report": report,
    "top_bits": widest_features,
    "quantized_bins": quantized_bins,
    "flow_embedding": flow_embedding,
    "flow_embedding_v1": flow_embedding_v1,
    "vector_sign_code": vector_sign_code,
    "lsh_keys": lsh_keys,
    "lsh_index": lsh_index,
    "hamming_distance": hamming_distance,
    "distance_stats": distance_stats,
    "distance_stats_v1": distance_stats_v1,
    "anomaly_threshold": anomaly_threshold,
    "lsh_candidates": lsh_candidates,
    "lsh_probe": lsh_probe,
    "lsh_knn": lsh_knn,
    "hamming_knn_exact": hamming_knn_exact,
    "lsh_recall": lsh_recall,
    "lsh_verdict": lsh_verdict,
    "lsh_verdict_v1": lsh_verdict_v1,
    "score_flows": score_flows,
    "lsh_index_stats": lsh_index_stats,
    "classification_metrics": classification_metrics,
    "roc_auc": roc_auc,
    "confusion_matrix": confusion_matrix,
    "anomaly_rate": anomaly_rate,
    "anomaly_rate_per_minute": anomaly_rate_per_minute,
    "metrics_over_seeds": metrics_over_seeds,
    "metric_long_summary": metric_long_summary,
    "feature_profile": feature_profile,
    "feature_corr_matrix": feature_corr_matrix,
    "redundant_pairs": redundant_pairs,
    "feature_code_corr": feature_code_corr,
    "embedding_histogram": embedding_histogram,
    "feature_ablation": feature_ablation,
    "top_features": top_features,
}
