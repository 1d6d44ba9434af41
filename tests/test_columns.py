"""Casts, features, keys and samples on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from flowsift.functions.coerce import double_or, read_long
from flowsift.functions.numeric import hamming, hamming_words, sign_code
from flowsift.operators import features, sampling
from flowsift.operators.features import Vocabularies, content_id, enrich, flow_features, flow_match_key
from flowsift.sources.flows import read_flows

CELLS = {
    "-": 0.0, "": 0.0, None: 0.0, "nan": 0.0, "NaN": math.nan, "inf": math.inf, " 12 ": 12.0, "1e3": 1000.0,
    "1d": 0.0, "1_000": 1000.0, "-3.9": -3.9, "0x10": 0.0, "abc": 0.0, "2f": 0.0,
}
WHOLE = {"-3.9": -3, "1e3": 1000, " 12 ": 12, "1_000": 1000}


def test_coercion_cells(spark):
    df = spark.createDataFrame([(c,) for c in CELLS], "cell string")
    rows = df.select("cell", double_or(F.col("cell")).alias("d"), read_long(df, "cell").alias("i")).collect()
    for r in rows:
        want = CELLS[r["cell"]]
        assert (math.isnan(r["d"]) and math.isnan(want)) or r["d"] == want, r
        assert r["i"] == WHOLE.get(r["cell"], 0), r


def test_features_edges(spark):
    rows = [
        (1, 0.0, "TCP", "http", "fin", 0, 0, 0, 0, 5.0, 0.0, "-"),
        (2, 2.0, "Udp", "-", "con", 4, 6, 100, 300, 8.0, 2.0, "12"),
        (3, float("nan"), "arp", None, None, 1, 1, 10, 10, 1.0, 1.0, "x"),
    ]
    schema = ("id bigint, dur double, proto string, service string, state string, spkts bigint, dpkts bigint, "
              "sbytes bigint, dbytes bigint, sload double, dload double, smean string")
    out = {r["id"]: r for r in flow_features(spark.createDataFrame(rows, schema)).collect()}
    assert out[1]["bytes_per_packet"] == 0 and out[1]["src_bytes_ratio"] == 0.5 and out[1]["load_ratio"] == 0
    assert out[2]["bytes_per_packet"] == 40 and out[2]["packets_per_second"] == 5 and out[2]["load_ratio"] == 4
    assert out[2]["protocol"] == 2 and out[3]["protocol"] == 1
    assert [out[i]["service_encoded"] for i in (1, 2, 3)] == [1, 2, 2]
    assert [out[i]["state_encoded"] for i in (1, 2, 3)] == [1, 2, 3]
    assert out[3]["packets_per_second"] == 0  # NaN duration is not positive
    assert out[3]["trans_depth"] == 0  # absent column


def test_unseen_category(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, service string")
    vocab = Vocabularies.learn(train, with_state=False).freeze()
    test = spark.createDataFrame([(3, "z"), (4, "B")], "id bigint, service string")
    got = {r["id"]: r["service_encoded"] for r in vocab.encode(test).collect()}
    assert got == {3: 3, 4: 2}


def test_unseen_category_above_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(features, "BROADCAST_ROWS", 2)
    train = spark.createDataFrame([(i, f"s{i}") for i in range(6)], "id bigint, service string")
    vocab = Vocabularies.learn(train, with_state=False).freeze()
    got = vocab.encode(spark.createDataFrame([(9, "new"), (10, "s3")], "id bigint, service string")).collect()
    assert {r["id"]: r["service_encoded"] for r in got} == {9: 7, 10: 4}


def test_sign_code_of_any_length(spark):
    for n in (0, 1, 64, 65, 128, 200):
        v = [1.0 if (i * i) % 7 in (1, 2) else -1.0 for i in range(n)]
        row = spark.createDataFrame([(v,)], "v array<float>").select(sign_code(F.col("v")).alias("c")).first()
        words = [sum(1 << i for i, x in enumerate(v[k : k + 64]) if x > 0) for k in range(0, n, 64)]
        assert [w % 2**64 for w in row["c"]] == words
    two = spark.createDataFrame([([0, -1], [0, 1])], "a array<bigint>, b array<bigint>")
    assert two.select(hamming_words(F.col("a"), F.col("b"))).first()[0] == 63


def test_match_key(spark):
    df = spark.createDataFrame(
        [(1, "10.0.0.1", "tcp", 1234), (2, "", "UDP", 0), (3, "10.0.0.3", "icmp", 5), (4, "x", None, 1)],
        "id bigint, srcip string, proto string, sport int",
    )
    got = {r["id"]: r["k"] for r in df.select("id", flow_match_key(df).alias("k")).collect()}
    assert got[1] == "ip_src=10.0.0.1,ip_dst=192.168.1.2,ip_proto=6,tcp_src=1234,tcp_dst=443"
    assert got[2] == "ip_dst=192.168.1.2,ip_proto=17,udp_dst=443"
    assert got[3] == "ip_src=10.0.0.3,ip_dst=192.168.1.2"
    assert got[4] is None


def test_content_id_and_enrichment(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (7, 1)], "id bigint, label int")
    ids = [r[0] for r in df.select(content_id(df)).collect()]
    assert ids[0] == ids[1] and len(ids[0]) == 32 and ids[2] == "7"
    row = enrich(df).where("flow_id = '7'").first()
    assert row["is_anomaly"] and row["anomaly_score"] == 0.0 and row["training_set"]


def test_bit_functions(spark):
    df = spark.createDataFrame([(0, -1), (5, 4), (-(1 << 63), 0)], "a bigint, b bigint")
    assert [r[0] for r in df.select(hamming(F.col("a"), F.col("b"))).collect()] == [64, 1, 1]
    vec = spark.createDataFrame([([1.0, -1.0, 0.0, 2.0],)], "v array<double>")
    assert vec.select(sign_code(F.col("v"))).first()[0] == [0b1001]


def test_csv_scan(spark, tmp_path):
    (tmp_path / "f.csv").write_text("label,dur,proto\n1,-,tcp\nx,0.5,udp\n")
    df = read_flows(spark, str(tmp_path / "f.csv"), "csv", raw=True)
    assert [(r["label"], r["dur"]) for r in df.collect()] == [(1, "-"), (0, "0.5")]
    assert read_flows(spark, str(tmp_path / "missing"), "csv") is None
    assert read_flows(spark, str(tmp_path / "missing")) is None


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(4000).select("id", (F.col("id") % 3 == 0).cast("int").alias("label")).repartition(5)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_large_sample_equals_top_n(spark, labelled, monkeypatch):
    want = ids(sampling.sample_n(labelled, 1500, 7))
    monkeypatch.setattr(sampling, "TOP_N_LIMIT", 10)
    assert ids(sampling.sample_n(labelled, 1500, 7)) == want and len(want) == 1500
    assert len(ids(sampling.sample_n(labelled, 9999, 7))) == 4000


def test_samples_of_all_seeds_in_one_scan(spark, labelled):
    out = sampling.sample_runs(labelled, {0: 300, 1: 5000}, [3, 11])
    for run, seed in enumerate([3, 11]):
        want = ids(sampling.stratified_sample(labelled, {0: 300, 1: 5000}, seed))
        assert ids(out.where(F.col("run") == run)) == want


@pytest.mark.parametrize("by", [(), ("run",)])
def test_vocabulary_in_stretches(spark, by):
    """Codes by first appearance, whatever the stretches: gaps, negative and missing positions, a hot value."""
    rows = [(run, pos, f"v{pos * 7 % 50}") for run in (0, 1) for pos in range(-40, 400, 3) if run == 0 or pos > 100]
    rows += [(0, 1_000, "hot")] * 500 + [(0, 5, "hot"), (0, None, "lost"), (0, 10**12, "far")]
    df = spark.createDataFrame(rows, "run int, id long, value string").withColumn("__n", F.lit(1))
    first = {}
    for run, pos, value in rows:
        key = (run if by else 0, value)
        first[key] = min(first.get(key, math.inf), -math.inf if pos is None else pos)
    expected = {}
    for run in {r for r, _ in first}:
        own = sorted((p, v) for (r, v), p in first.items() if r == run)
        expected |= {(run, v): i + 1 for i, (_, v) in enumerate(own)}
    for span in (1, 16, 1_000_000):
        got = features.vocabulary(df, F.col("value"), by=by, span=span).collect()
        assert {(r["run"] if by else 0, r["value"]): r["code"] for r in got} == expected
        assert len(got) == len(expected)


def test_vocabulary_of_nothing(spark):
    assert features.vocabulary(spark.createDataFrame([], "id long, service string"), F.col("service")).collect() == []


def test_grid_beyond_the_range_of_bigint(spark):
    from flowsift.functions.numeric import grid

    values = [1.5638400001234e13, -3.2e13, 1e300, float("inf"), 1.2345678, -0.0000004]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    found = [r["g"] for r in df.select("i", grid(F.col("v")).alias("g")).orderBy("i").collect()]
    assert found == [(v * 1e6 + 0.5) / 1e6 for v in values[:4]] + [1.234568, 0.0]
