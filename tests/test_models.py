"""Quantiles, bins, index, verdicts and detector against numpy and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from flowsift.operators import lsh, quantiles
from flowsift.operators.quantizer import FeatureBins, QuantizerModel, encode_runs, fit_bins, fit_quantizer
from flowsift.operators.verdict import with_verdict
from flowsift.plans import catalog, detector as plans
from flowsift.schema import LSH_V1, LSH_V2, QUANTIZER_V1, QUANTIZER_V2


def values(spark, numbers):
    return spark.createDataFrame([("a", float(v)) for v in numbers], "g string, value double")


@pytest.mark.parametrize("limit", [2_000_000, 10])
def test_exact_quantiles(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "SINGLE_WINDOW_ROWS", limit)
    monkeypatch.setattr(quantiles, "BUCKET_ROWS", 50)
    rng = np.random.RandomState(0)
    numbers = np.concatenate([rng.lognormal(2, 2, 500), np.full(300, 4.5), [0.0] * 50])
    points = [0.0, 0.01, 0.15, 0.5, 0.99, 1.0]
    row = quantiles.exact_quantiles(values(spark, numbers), "value", points, ["g"]).first()
    assert [row[f"q{i}"] for i in range(6)] == list(np.percentile(numbers, [p * 100 for p in points]))


def test_bins_equal_numpy(spark):
    rng = np.random.RandomState(1)
    n = 700
    table = {
        "total_packets": rng.randint(0, 40, n), "protocol": rng.randint(1, 4, n), "bytes_per_packet": rng.lognormal(3, 1, n),
        "duration": rng.uniform(1, 3, n), "total_bytes": rng.randint(0, 9999, n), "packets_per_second": rng.exponential(5, n),
        "service_encoded": rng.randint(1, 6, n), "dst_load": rng.choice([0.0, 1.5, 9.0], n), "mean_packet_size": rng.uniform(0, 1, n),
    }
    names = list(table)
    rows = [(i, *[float(table[c][i]) for c in names]) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{c} double" for c in names))
    model = fit_quantizer(df, QUANTIZER_V2)
    assert model.bins["duration"].type == "continuous" and model.bins["duration"].bits == 6
    edge = spark.createDataFrame(rows + [(n, *[float("nan")] * 9), (n + 1, *[1e12] * 9), (n + 2, *[-5.0] * 9)], df.schema)
    got = model.with_bins(edge).orderBy("id").toPandas()
    for name in names:
        b = model.bins[name]
        x = np.array([r[1 + names.index(name)] for r in rows])
        if b.categories:
            continue
        if b.min_val is not None:
            assert [b.min_val, b.max_val] == list(np.percentile(x, [1, 99]))
            kept = x[(x >= b.min_val) & (x <= b.max_val)]
            assert list(b.thresholds) == list(np.percentile(kept, np.linspace(0, 100, 2**b.bits)))
            x = np.clip(x, b.min_val, b.max_val)
        elif b.type == "log_continuous":
            continue  # log10 differs in the last bit between libraries
        else:
            assert list(b.thresholds) == list(np.percentile(x, np.linspace(0, 100, 2**b.bits)))
        want = np.minimum(np.searchsorted(b.thresholds, x), len(b.thresholds) - 1)
        assert (got[f"{name}_bin"][:n] == want).all(), name
        assert got[f"{name}_bin"][n] == len(b.thresholds) - 1  # NaN goes last
    # The broadcast-table encoder gives the same codes as the literal one.
    one = model.encode(edge)
    many = encode_runs(edge.withColumn("run", F.lit(0)), {0: model}, ("id",))
    assert one.exceptAll(many).count() == 0


def test_support_guard_and_category_bits(spark):
    few = spark.createDataFrame([(i, float(i % 3), 1.0) for i in range(9)], "id bigint, service_encoded double, duration double")
    spec = QUANTIZER_V2
    missing = [c for c in spec.features if c not in few.columns]
    filled = few.select("*", *[F.lit(float("nan")).alias(c) for c in missing])
    model = fit_quantizer(filled, spec)
    assert model.bins == {} and model.bits("duration") == 2
    for size, v2, v1 in [(1, 2, 1), (3, 2, 2), (4, 3, 3), (7, 3, 3), (8, 4, 4), (15, 4, 4), (16, 5, 4), (255, 8, 4), (300, 8, 4)]:
        n = max(size, 12)
        df = spark.createDataFrame([(i, 1.0 + i % size) for i in range(n)], "id bigint, service_encoded double")
        df = df.select("*", *[F.lit(float("nan")).alias(c) for c in QUANTIZER_V1.features if c != "service_encoded"])
        assert fit_bins(df, QUANTIZER_V2)[0]["bits"] == v2
        assert fit_bins(df, QUANTIZER_V1)[0]["bits"] == v1


def test_layout_skips_what_does_not_fit():
    def of(bits):
        return QuantizerModel(QUANTIZER_V2, {f: FeatureBins(f, "continuous", b, 10, (0.0,) * 2) for f, b in bits.items()})

    model = of(dict(zip(QUANTIZER_V2.priority, [10, 2, 8, 8, 10, 8, 8, 6, 6])))
    assert sum(w for _, w in model.layout()) == 60 and "mean_packet_size" not in dict(model.layout())
    model = of(dict(zip(QUANTIZER_V2.priority, [10, 2, 8, 8, 10, 8, 8, 12, 6])))
    assert "dst_load" not in dict(model.layout()) and "mean_packet_size" in dict(model.layout())


def parity_keys(codes, family):
    out = np.zeros((len(codes), family.tables), dtype=np.int64)
    for t, table in enumerate(family.masks):
        for f, mask in enumerate(table):
            out[:, t] |= (np.bitwise_count(codes.view(np.uint64) & np.uint64(mask)) & 1).astype(np.int64) << f
    return out


def clustered(n, seed):
    """Codes that differ in few bits, so buckets are full; bit 63 occurs."""
    rng = np.random.RandomState(seed)
    base = np.array([0x123456789ABCDEF0, 0xF00000000000000F], dtype=np.uint64)
    codes = base[rng.randint(0, 2, n)]
    for _ in range(3):
        codes = codes ^ (np.uint64(1) << rng.randint(0, 64, n).astype(np.uint64))
    return codes.view(np.int64)


@pytest.mark.parametrize("way", ["broadcast", "split"])
@pytest.mark.parametrize("spec", [LSH_V2, LSH_V1], ids=["v2", "v1"])
def test_neighbours_equal_brute_force(spark, monkeypatch, spec, way, tmp_path):
    if way == "split":
        monkeypatch.setattr(lsh, "BROADCAST_INDEX_ROWS", 0)
        monkeypatch.setattr(lsh, "HOT_BUCKET_CODES", 2)
    train, test = clustered(400, 1), np.concatenate([clustered(150, 2), np.random.RandomState(3).randint(0, 2**62, 20)])
    df = spark.createDataFrame([(i, int(c)) for i, c in enumerate(train)], "id bigint, embedding bigint")
    model = lsh.fit_lsh(df, 42, spec)
    if way == "split":
        assert model.hot
        model.save(str(tmp_path))
        model = lsh.LshModel.load(spark, str(tmp_path))
    queries = spark.createDataFrame([(0, int(c)) for c in test], "run int, embedding bigint")
    got = {r["embedding"]: r for r in lsh.knn(model, queries).collect()}
    known = np.unique(train)
    kt, kq = parity_keys(known, model.families[0]), parity_keys(test, model.families[0])
    firsts = []
    for t in range(spec.probe_tables):
        first = {}
        for key in parity_keys(train, model.families[0])[:, t]:
            first.setdefault(int(key), None)
        firsts.append(set(list(first)[: spec.probe_keys]))
    for i, code in enumerate(test):
        hit = (kt == kq[i]).any(axis=1)
        if not hit.any():
            for t in range(spec.probe_tables):
                near = np.bitwise_count(kt[:, t] ^ kq[i, t]) <= spec.probe_bits
                hit |= near & np.isin(kt[:, t], list(firsts[t]))
        d = np.sort(np.bitwise_count((known[hit] ^ code).view(np.uint64)).astype(int))
        r, k = got[int(code)], min(spec.neighbours, len(d))
        assert r["candidates"] == len(d)
        if len(d):
            assert r["min_distance"] == d[0] and abs(r["avg_distance"] - d[:k].mean()) < 1e-12


def test_index_recall_on_near_codes(spark):
    """An indexed code always finds itself; candidates are a subset of all codes."""
    train = clustered(200, 5)
    df = spark.createDataFrame([(i, int(c)) for i, c in enumerate(train)], "id bigint, embedding bigint")
    model = lsh.fit_lsh(df, 1, LSH_V2)
    got = lsh.knn(model, df.withColumn("run", F.lit(0)))
    assert got.agg(F.max("min_distance")).first()[0] == 0


def test_distance_defaults(spark):
    one = spark.createDataFrame([(1, 5)], "id bigint, embedding bigint")
    for df in (one, one.limit(0)):
        s = lsh.fit_lsh(df, 42, LSH_V2).stats[0]
        assert (s["mean"], s["std"], s["p25"], s["threshold"]) == (32.0, 8.0, 24.0, 24.0)
    assert lsh.fit_lsh(one, 42, LSH_V1).stats[0]["threshold"] == 24.0


def test_verdict_rules(spark):
    model = lsh.fit_lsh(spark.createDataFrame([(1, 5)], "id bigint, embedding bigint"), 42, LSH_V2)  # T=24, p75=40
    rows = [(0, 0, None, None), (0, 9, 3, 3.0), (0, 4, 3, 3.0), (0, 9, 25, 26.0), (0, 9, 20, 27.0), (0, 9, 41, 41.0)]
    df = spark.createDataFrame(rows, "run int, candidates bigint, min_distance int, avg_distance double")
    got = [(r["is_anomaly"], round(r["score"], 6)) for r in with_verdict(df, model).collect()]
    assert got == [(True, 0.9), (False, 0.0), (True, 0.75), (True, round(0.7 + 0.3 * 25 / 64, 6)),
                   (True, round(0.6 + 0.4 * 27 / 64, 6)), (True, round(0.7 + 0.3 * 41 / 64, 6))]


def test_detector_paths_agree(spark, monkeypatch, tmp_path):
    d = catalog.detector(spark, SMALL)
    s = d.lsh.stats[0]
    assert s["p25"] >= s["mean"] - 2 * s["std"]
    flows = catalog.test_flows(spark, SMALL)
    want = d.score(flows, ("label",)).toPandas().sort_values("id").reset_index(drop=True)
    monkeypatch.setattr(plans, "BROADCAST_VERDICTS", 0)
    monkeypatch.setattr(plans, "HOT_SHARE", 200)
    d.save(str(tmp_path))
    again = plans.FlowDetector.load(spark, str(tmp_path))
    got = again.score(flows.repartition(7), ("label",)).toPandas().sort_values("id").reset_index(drop=True)
    assert want.equals(got) and len(got) == flows.count()


def test_batches_leave_no_cached_tables(spark, tmp_path):
    from flowsift.functions.held import hold, held_tables

    found = catalog.detector(spark, SMALL)
    flows = catalog.test_flows(spark, SMALL)
    cached = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    before = cached()
    for i in range(10):
        with held_tables():
            scored = hold(found.score(flows.where(F.col("id") % 10 == i), ("label",)))
            scored.write.mode("overwrite").parquet(str(tmp_path / "scored"))
    assert cached() == before


def test_svm_score_is_on_the_kernel_scale(spark):
    from flowsift.operators import baselines

    rng = np.random.RandomState(1)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(400)]
    vectors = spark.createDataFrame(rows, "id bigint, features array<double>")
    model = baselines.fit_ocsvm(vectors, nu=0.1, components=64, rounds=3)
    assert model.scale == pytest.approx(40)
    raw = {r["id"]: r["raw"] for r in vectors.select("id", model.decision(F.col("features")).alias("raw")).collect()}
    for r in model.score(vectors).collect():
        assert r["score"] == pytest.approx(1 - (raw[r["id"]] * 40 + 0.5))


def test_forest_draws_from_all_rows(spark):
    from flowsift.operators import baselines

    vectors = spark.range(5000).selectExpr("id", "array(cast(id as double), cast(id % 7 as double)) AS features")
    forest = baselines.fit_iforest(vectors, trees=20, sample=64)
    roots = forest.nodes[forest.nodes["node"] == 0]
    assert len(roots) == 20 and (roots["size"] == 64).all()


def test_cached_tables_have_an_owner(spark):
    """Shared models give their index back; seeds release theirs with their scope; a released detector still scores."""
    from conftest import SMALL
    from flowsift.plans import catalog

    catalog.forget()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    model = catalog.detector(spark, SMALL)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() > before
    catalog.seed_metrics(spark, SMALL)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before + 2  # the index and the metrics
    catalog.forget()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert model.score(catalog.test_flows(spark, SMALL)).count() > 0


@pytest.mark.parametrize("spec", [LSH_V2, LSH_V1], ids=["v2", "v1"])
def test_settled_queries_keep_their_verdict(spark, monkeypatch, spec):
    """Normal queries leave on a share of the codes; their verdicts are those of all candidates."""
    from flowsift.operators.verdict import settled

    train, test = clustered(4000, 1), np.concatenate([clustered(600, 2), np.random.RandomState(3).randint(0, 2**62, 20)])
    df = spark.createDataFrame([(i, int(c)) for i, c in enumerate(train)], "id bigint, embedding bigint")
    model = lsh.fit_lsh(df, 42, spec)
    assert model.codes.count() == len(np.unique(train)) and model.index_rows == spec.tables * len(np.unique(train))
    queries = spark.createDataFrame([(0, int(c)) for c in test], "run int, embedding bigint")

    def verdicts(found):
        return {r["embedding"]: (r["is_anomaly"], spec.version == "v2" and r["score"]) for r in with_verdict(found, model).collect()}

    full = lsh.knn(model, queries)
    monkeypatch.setattr(lsh, "BROADCAST_INDEX_ROWS", 300 * spec.tables)
    monkeypatch.setattr(lsh, "ROUND_STEP", 2)
    early = lsh.knn(model, queries, settled(spec, flags_only=True))
    assert verdicts(full) == verdicts(early) and early.count() == len(np.unique(test))
    total = lambda found: found.agg(F.sum("candidates")).first()[0]
    assert total(early) < total(full)


def test_coders_have_no_index(spark):
    catalog.forget()
    assert catalog.flow_embedding(spark, SMALL).count() == catalog.event_flows(spark, SMALL).where("split = 'test' or label = 0").count()
    assert not any("detector" in key[2] for key in catalog._shared)


@pytest.mark.parametrize("spec", [LSH_V1, LSH_V2])
@pytest.mark.parametrize("one_in", [1, 3])
def test_bucket_mates_in_blocks(spark, monkeypatch, spec, one_in):
    """Bucket by bucket as by a join: small, large and hot buckets, two runs, negative codes, queries without mates."""
    rng = np.random.RandomState(3)
    crowd = [int(c) for c in np.unique(rng.randint(0, 2**12, 900) - 2**11)]
    train = [(r, i, c ^ (r << 40)) for r in (0, 1) for i, c in enumerate(crowd + [int(c) for c in rng.randint(-(2**62), 2**62, 50)])]
    tests = [(r, c ^ 5 ^ (r << 40)) for r in (0, 1) for c in crowd[:120]] + [(0, int(c)) for c in rng.randint(-(2**62), 2**62, 30)]
    families = {r: lsh.HashFamily.draw(r, spec) for r in (0, 1)}
    codes = spark.createDataFrame(train, "run int, id bigint, embedding bigint")
    stats = lsh.distance_stats(lsh.number_sample(codes, F.lit(1), spec), spec)
    monkeypatch.setattr(lsh, "HOT_BUCKET_CODES", 2 if spec is LSH_V1 else 40)
    monkeypatch.setattr(lsh, "BROADCAST_INDEX_ROWS", 10)
    model = lsh.finish_model(lsh.index_codes(codes, families).persist(), families, stats, spec)
    assert model.hot
    queries = model.hash(spark.createDataFrame(tests, "run int, embedding bigint").distinct())
    joined = {(r.run, r.query): r for r in lsh.nearest(lsh.bucket_pairs(model, queries, one_in=one_in), spec.neighbours).collect()}
    for limit in (lsh.TILE_PAIRS, 64):
        monkeypatch.setattr(lsh, "TILE_PAIRS", limit)
        monkeypatch.setattr(lsh, "BLOCK_ROWS", 3_000)
        found = lsh.nearest_mates(model, queries, spec.neighbours, one_in=one_in)
        assert "MapInArrow" in found._jdf.queryExecution().toString()
        assert {(r.run, r.query): r for r in found.collect()} == joined and len(joined) > 150
