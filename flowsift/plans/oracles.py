"""DuckDB SQL for each registered query that SQL can express."""

from __future__ import annotations

from flowsift.operators.lsh import HashFamily
from flowsift.plans import sql_steps as S
from flowsift.schema import (
    EXPERIMENT_SEEDS, FEATURES, LSH_MODEL, LSH_V1, LSH_V2, OPTIMIZED_FEATURES, QUANTIZER_V1, QUANTIZER_V2, VECTOR8, VECTOR8_TEXT,
)

G = S.grid
TRAIN = "SELECT *, 0 AS run FROM flows WHERE split = 'train' AND label = 0"
TEST = "SELECT *, 0 AS run FROM flows WHERE split = 'test'"
V2 = S.chain("v2", {0: 42}, TRAIN, TEST)
V1 = S.chain("v1", {0: 42}, TRAIN, TEST)
ALL = f"WITH {S.FLOWS}, everything AS (SELECT *, 0 AS run FROM flows), {S.features('feats', 'everything')}"
WHOLE = {
    "duration", "mean_packet_size", "bytes_per_packet", "bytes_per_second", "packets_per_second",
    "src_bytes_ratio", "src_packets_ratio", "src_load", "dst_load", "load_ratio",
}


def rounded(names) -> str:
    return ", ".join(f"{G(n)} AS {n}" if n in WHOLE else n for n in names)


SIGN_WORDS = """signs AS (
  SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings
), words AS (
  SELECT vec_id, label, (i // 64)::INT AS word,
    sum(CASE WHEN x > 0 THEN CASE WHEN i % 64 = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << (i % 64)::INT) END ELSE 0::HUGEINT END)::BIGINT AS code
  FROM signs GROUP BY vec_id, label, i // 64)"""


def params_rows(cte: str) -> str:
    return f"""{cte}
SELECT feature, type, bits, n_values, {G('min_val')} AS min_val, {G('max_val')} AS max_val, (u.i - 1)::INT AS i, {G('u.v')} AS level
FROM (SELECT *, coalesce(thresholds, categories) AS lv FROM params) p,
  LATERAL (SELECT unnest(range(1, len(p.lv) + 1)) AS i, unnest(p.lv) AS v) u"""


def report(cte: str) -> str:
    return f"""{cte}
SELECT feature, CASE WHEN type = 'categorical' THEN 'categorical' ELSE 'continuous' END AS kind, bits,
  len(coalesce(thresholds, categories))::INT AS levels FROM params"""


# The record as JSON with sorted keys, after its id.
EVENT_JSON = (
    """'"event_type":"' || event_type || '","props":"' || replace(props, '"', chr(92) || '"') || '","ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') """
    """|| '","user_id":' || user_id || ',"value":' || CAST(value AS VARCHAR) || '}'"""
)
FLOW_JSON = "'{' || " + " || ',' || ".join(
    f"""'"{n}":' || CAST({n}::DOUBLE AS VARCHAR)""" if n in VECTOR8 else
    {"flow_id": """'"flow_id":"' || CASE WHEN id = 0 THEN 'hashed' ELSE CAST(id AS VARCHAR) END || '"'""", "label": """'"label":' || label""",
     "is_anomaly": """'"is_anomaly":' || CASE WHEN label = 1 THEN 'true' ELSE 'false' END"""}.get(n, f"""'"{n}":"' || {n} || '"'""")
    for n in sorted({*VECTOR8, *VECTOR8_TEXT, "flow_id", "label", "is_anomaly"} - {"dur", "rate"})
) + " || '}'"
METRIC_COUNTS = """
  sum(CASE WHEN is_anomaly AND label = 1 THEN 1 ELSE 0 END)::BIGINT AS tp,
  sum(CASE WHEN is_anomaly AND label = 0 THEN 1 ELSE 0 END)::BIGINT AS fp,
  sum(CASE WHEN NOT is_anomaly AND label = 1 THEN 1 ELSE 0 END)::BIGINT AS fn,
  sum(CASE WHEN NOT is_anomaly AND label = 0 THEN 1 ELSE 0 END)::BIGINT AS tn"""


def predictions(chain: str, model: str = LSH_MODEL) -> str:
    return f"""{chain}, predictions AS (
  SELECT v.run, v.id, t.label, t.ts, '{model}' AS model, v.is_anomaly, v.score FROM verdict v JOIN test t ON t.run = v.run AND t.id = v.id
), counts AS (SELECT run, model, {METRIC_COUNTS} FROM predictions GROUP BY run, model),
metrics AS (
  SELECT run, model, tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS "precision",
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
    CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1_score,
    tp + fp + fn + tn AS total_samples, tp + fp AS anomalies_detected, tp + fn AS true_anomalies FROM counts
), by_score AS (
  SELECT run, model, score, sum(label) AS pos, sum(1 - label) AS neg FROM predictions GROUP BY ALL
), running AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY run, model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM by_score
), auc AS (
  SELECT run, model, CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(pos * (below + 0.5e0 * neg)) / (sum(pos)::DOUBLE * sum(neg)) ELSE 0.0e0 END AS roc_auc FROM running GROUP BY run, model
), full_metrics AS (SELECT m.*, a.roc_auc FROM metrics m JOIN auc a USING (run, model))"""


RATE_COLUMNS = ("accuracy", "precision", "recall", "f1_score")
RATES = ", ".join(f'{G(chr(34) + r + chr(34))} AS "{r}"' for r in RATE_COLUMNS)
P2 = predictions(V2)


# All pairs of test and training codes, and how many of the k nearest lie at each distance.
ALL_PAIRS = f"""{V2}, every_pair AS (
  SELECT q.embedding AS q, bit_count(xor(q.embedding, i.embedding))::INT AS d, count(*) AS n
  FROM (SELECT DISTINCT embedding FROM test_codes) q, (SELECT DISTINCT embedding FROM train_codes) i GROUP BY ALL
), cumulated AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY q ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM every_pair
), taken AS (
  SELECT q, d, least(n, {LSH_V2.neighbours} - before)::BIGINT AS take FROM cumulated WHERE before < {LSH_V2.neighbours}
)"""


def seeds_chain() -> str:
    runs = dict(enumerate(EXPERIMENT_SEEDS))
    seed = "CASE run " + " ".join(f"WHEN {r} THEN {s}" for r, s in runs.items()) + " END"

    def draw(where: str, n: int) -> str:
        return (f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY {S.seeded(seed)}, id) AS rn "
                f"FROM (SELECT f.*, unnest(range({len(runs)}))::INT AS run FROM flows f WHERE {where})) WHERE rn <= {n}")

    train = draw("split = 'train' AND label = 0", 3000)
    test = draw("split = 'test' AND label = 0", 800) + " UNION ALL " + draw("split = 'test' AND label = 1", 400)
    return predictions(S.chain("v2", runs, train, test))


def histogram(cte: str, source: str, bins: int) -> str:
    return f"""{cte}, numbers AS (SELECT v::DOUBLE AS v FROM ({source})), hist_ends AS (SELECT min(v) AS lo, max(v) AS hi FROM numbers),
placed AS (SELECT least(greatest(floor((v - lo) / (hi - lo) * {bins}.0e0), 0), {bins - 1})::INT AS bin, count(*) AS n FROM numbers, hist_ends GROUP BY ALL)
SELECT b.bin::INT AS bin, lo + b.bin * ((hi - lo) / {bins}) AS lower, lo + (b.bin + 1) * ((hi - lo) / {bins}) AS upper, coalesce(n, 0) AS rows
FROM (SELECT unnest(range({bins})) AS bin) b CROSS JOIN hist_ends LEFT JOIN placed p ON p.bin = b.bin"""


def profile_rows(names) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS feature, {S.grid(f'avg({n}::DOUBLE)', '1e2')} AS mean, {S.grid(f'stddev_pop({n}::DOUBLE)', '1e2')} AS std, "
        f"{G(f'min({n}::DOUBLE)')} AS min, {G(f'max({n}::DOUBLE)')} AS max, "
        f"{G(f'avg(CASE WHEN {n} = 0 THEN 1.0e0 ELSE 0.0e0 END)')} AS zero_ratio FROM feats" for n in names
    )


def corr_pairs(names) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}::DOUBLE, {b}::DOUBLE) AS correlation FROM feats"
        for a in names for b in names
    )
    return rows


def ablation_chain() -> str:
    """v1 codes without each priority feature: run 0 is the full set."""
    order = QUANTIZER_V1.priority
    base = V1.split("feature_order(run, i, feature)")[0].rstrip().rstrip(",")
    runs = {0: None, **dict(enumerate(order, 1))}
    orders = {r: tuple(f for f in order if f != gone) for r, gone in runs.items()}
    parts = [S.layout(orders, QUANTIZER_V1.code_bits, shared_params=True)]
    for side in ("train", "test"):
        parts.append(f"{side}_codes AS MATERIALIZED (SELECT s.run, b.id, bit_or(b.bin << s.shift) AS embedding FROM {side}_bins b JOIN shifts s USING (feature) GROUP BY s.run, b.id)")
    family = HashFamily.draw(42, LSH_V1)
    parts += [
        S.masks({r: family for r in runs}), S.stats("train_codes", {r: 42 for r in runs}, LSH_V1),
        S.neighbours("train_codes", "test_codes", LSH_V1), S.verdict("test_codes", LSH_V1),
    ]
    chain = base + "," + ",".join(parts)
    counted = f"""{chain}, counts AS (
  SELECT v.run, sum(CASE WHEN is_anomaly AND label = 1 THEN 1 ELSE 0 END) AS tp,
    sum(CASE WHEN is_anomaly AND label = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN NOT is_anomaly AND label = 1 THEN 1 ELSE 0 END) AS fn
  FROM verdict v JOIN test t ON t.id = v.id GROUP BY v.run
), f1 AS (SELECT run, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1_score FROM counts),
names(removed_feature, run) AS (VALUES {', '.join(f"('{f}', {order.index(f) + 1 if f in order else 0})" for f in FEATURES)}),
ablation AS (
  SELECT n.removed_feature, f.f1_score, b.f1_score - f.f1_score AS f1_drop,
    CASE WHEN b.f1_score > 0 THEN (b.f1_score - f.f1_score) / b.f1_score ELSE 0.0e0 END AS relative_drop
  FROM names n JOIN f1 f ON f.run = n.run JOIN f1 b ON b.run = 0
)"""
    return counted


ABLATION_COLUMNS = f"removed_feature, {G('f1_score')} AS f1_score, {G('f1_drop')} AS f1_drop, {G('relative_drop')} AS relative_drop"


def scaled(names, source: str) -> str:
    cells = ", ".join(
        f"{G(f'({n}::DOUBLE - avg({n}::DOUBLE) OVER ()) / coalesce(nullif(stddev_pop({n}::DOUBLE) OVER (), 0), 1)')} AS {n}" for n in names
    )
    return f"SELECT id, {cells} FROM {source}"


def sql() -> dict[str, str]:
    matrix = ", ".join(f"coalesce({n}::DOUBLE, 0)" for n in sorted(OPTIMIZED_FEATURES))
    flows = f"WITH {S.FLOWS}"
    q = {
        # sources and sinks
        "flow_scan": f"{flows} SELECT id, ts, {G('dur')} AS dur, proto, service, state, spkts, dpkts, sbytes, dbytes, {G('rate')} AS rate, sttl, dttl, "
                     f"{G('sload')} AS sload, {G('dload')} AS dload, smean, trans_depth, ct_src_dport_ltm, ct_dst_sport_ltm, label, split FROM flows",
        "prediction_detail": f"{P2} SELECT id, model, is_anomaly::INT AS prediction, {G('score')} AS score, label AS true_label, is_anomaly::INT = label AS correct FROM predictions",
        "anomalous_flows": f"{P2} SELECT p.id, {G('p.score')} AS detection_score, p.label AS true_label, p.ts AS timestamp, p.model AS detected_by_model, "
                           "t.proto, t.service, t.state, t.sbytes, t.dbytes, t.spkts, t.dpkts FROM predictions p JOIN test t ON t.id = p.id WHERE p.is_anomaly",
        "run_performance": f"{P2} SELECT model, 'run-42' AS run_ts, 42 AS random_seed, total_samples AS flows_processed, {RATES}, {G('roc_auc')} AS roc_auc, total_samples, anomalies_detected, true_anomalies FROM full_metrics",
        "enriched_flow_table": f"{flows} SELECT " + ", ".join(f"{G(n)} AS {n}" if n in ("dur", "rate") else f"{n}::DOUBLE AS {n}" for n in VECTOR8)
                               + f", proto, service, state, CASE WHEN id = 0 THEN 'hashed' ELSE CAST(id AS VARCHAR) END AS flow_id, label, label = 1 AS is_anomaly, {FLOW_JSON} AS flow_description, 0.0e0 AS anomaly_score, split = 'train' AS training_set FROM flows",
        # projections
        "coerce_double": f"{flows} SELECT id, CASE WHEN smean IN ('-', '', 'nan') THEN -1.0e0 ELSE coalesce(try_cast(smean AS DOUBLE), -1.0e0) END AS value FROM flows",
        "coerce_int": f"{flows} SELECT id, CASE WHEN smean IN ('-', '', 'nan') THEN 0 ELSE coalesce(trunc(try_cast(smean AS DOUBLE))::BIGINT, 0) END::BIGINT AS value, trunc(dur)::BIGINT AS whole_seconds FROM flows",
        "coerce_label": "SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END::INT AS label FROM events",
        "protocol_code": f"{ALL} SELECT id, protocol FROM feats",
        "service_vocab": f"{ALL} SELECT value, code FROM feats_service",
        "state_vocab": f"{ALL} SELECT value, code FROM feats_state",
        "service_encode": f"{ALL} SELECT id, service_encoded, state_encoded FROM feats",
        "flow_features": f"{ALL} SELECT id, {rounded(FEATURES)} FROM feats",
        "flow_features_optimized": f"{ALL} SELECT id, {rounded(OPTIMIZED_FEATURES)} FROM feats",
        "feature_matrix": f"{ALL} SELECT id, (u.p - 1)::INT AS pos, {G('u.v')} AS value FROM (SELECT id, [{matrix}] AS m FROM feats) f, LATERAL (SELECT unnest(range(1, 10)) AS p, unnest(f.m) AS v) u",
        "feature_long": f"{ALL} SELECT id, feature, {G('value')} AS value FROM ({S.unpivot('feats', OPTIMIZED_FEATURES)})",
        "flow_vector8": f"{flows} SELECT id, " + ", ".join(f"{G(n)} AS {n}" if n in ("dur", "rate") else f"{n}::DOUBLE AS {n}" for n in VECTOR8) + ", proto, service, state FROM flows",
        "content_id": f"SELECT event_id, CASE WHEN event_id <> 0 THEN CAST(event_id AS VARCHAR) ELSE md5('{{' || {EVENT_JSON}) END AS own_id, "
                      f"md5('{{\"event_id\":' || event_id || ',' || {EVENT_JSON}) AS content_hash FROM events",
        "flow_match_key": f"{flows} SELECT id, concat('ip_src=192.168.1.1,ip_dst=192.168.1.2', CASE lower(proto) WHEN 'tcp' THEN ',ip_proto=6,tcp_src=80,tcp_dst=443' WHEN 'udp' THEN ',ip_proto=17,udp_src=80,udp_dst=443' ELSE '' END) AS match_key FROM flows",
        # filters and samples
        "normal_flows": f"{flows} SELECT id, label FROM flows WHERE label = 0",
        "sample_normal": f"{flows} SELECT id, label FROM (SELECT * FROM flows WHERE split = 'train' AND label = 0 ORDER BY {S.seeded('42')}, id LIMIT 3000)",
        "stratified_test": f"{flows} SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {S.seeded('42')}, id) AS rn FROM flows WHERE split = 'test') WHERE rn <= CASE label WHEN 0 THEN 800 ELSE 400 END",
        "stream_sample": f"{flows} SELECT id, label FROM (SELECT * FROM flows WHERE split = 'test' ORDER BY {S.seeded('42')}, id LIMIT 1000)",
        "embedding_diversity": f"{V2} SELECT count(*) AS flows, count(DISTINCT embedding) AS codes FROM train_codes",
        # quantizer
        "quantizer_params": params_rows(V2),
        "quantizer_params_v1": params_rows(V1),
        "quantizer_report": report(V1),
        "top_bits": report(V1) + " ORDER BY bits DESC, feature LIMIT 10",
        "quantized_bins": f"{V2} SELECT id, feature, bin FROM test_bins",
        "flow_embedding": f"{V2} SELECT id, embedding FROM test_codes UNION ALL SELECT id, embedding FROM train_codes",
        "flow_embedding_v1": f"{V1} SELECT id, embedding FROM test_codes UNION ALL SELECT id, embedding FROM train_codes",
        "vector_sign_code": f"WITH {SIGN_WORDS} SELECT vec_id, word, code FROM words",
        # index and verdict
        "lsh_keys": f"{V2} SELECT code AS embedding, t::INT AS table_idx, hash_key::INT AS hash_key FROM qkeys",
        "lsh_index": f"{V2} SELECT t::INT AS table_idx, hash_key::INT AS hash_key, code AS embedding, n_flows, first_pos FROM idx",
        "hamming_distance": f"WITH {SIGN_WORDS}, firsts AS (SELECT label, word, arg_min(code, vec_id) AS first_code FROM words GROUP BY label, word) "
                            "SELECT vec_id, sum(bit_count(xor(code, first_code)))::INT AS distance FROM words JOIN firsts USING (label, word) GROUP BY vec_id",
        "distance_stats": f"{V2} SELECT {', '.join(f'{G(c)} AS {c}' for c in ('mean', 'std', 'p10', 'p25', 'p50', 'p75', 'p90'))} FROM stats",
        "distance_stats_v1": f"{V1} SELECT {', '.join(f'{G(c)} AS {c}' for c in ('mean', 'std'))} FROM stats",
        "anomaly_threshold": f"{V2} SELECT {G('threshold')} AS threshold FROM stats",
        "lsh_candidates": f"{V2} SELECT q AS embedding, count(*) AS candidates FROM pairs GROUP BY q",
        "lsh_probe": f"{V2} SELECT m.code AS embedding, count(p.c) AS candidates FROM missed m LEFT JOIN probed p ON p.run = m.run AND p.q = m.code GROUP BY m.code",
        "lsh_knn": f"{V2} SELECT embedding, candidates, min_distance, k, {G('avg_distance')} AS avg_distance, probed FROM knn",
        "hamming_knn_exact": f"{ALL_PAIRS} SELECT q AS embedding, sum(take)::BIGINT AS k, min(d) AS min_distance, max(d) AS kth_distance, "
                             f"{G('sum(take * d)::DOUBLE / sum(take)')} AS avg_distance FROM taken GROUP BY q",
        "lsh_recall": f"{ALL_PAIRS}, mates AS (SELECT q, bit_count(xor(q, c))::INT AS d, count(*) AS mates FROM pairs GROUP BY ALL) "
                      f"SELECT d AS distance, sum(take)::BIGINT AS true_neighbours, sum(least(take, coalesce(mates, 0)))::BIGINT AS found, "
                      f"{G('sum(least(take, coalesce(mates, 0)))::DOUBLE / sum(take)')} AS recall FROM taken LEFT JOIN mates USING (q, d) GROUP BY d",
        "lsh_verdict": f"{V2} SELECT DISTINCT embedding, is_anomaly, {G('score')} AS score FROM verdict",
        "lsh_verdict_v1": f"{V1} SELECT DISTINCT embedding, is_anomaly, {G('score')} AS score FROM verdict",
        "score_flows": f"{P2} SELECT id, model, is_anomaly, {G('score')} AS score FROM predictions",
        "lsh_index_stats": f"{V2}, buckets AS (SELECT t, hash_key, count(*) AS codes, sum(n_flows) AS flows FROM idx GROUP BY t, hash_key) "
                           f"SELECT t::INT AS table_idx, count(*) AS buckets, sum(codes)::BIGINT AS codes, sum(flows)::BIGINT AS flows, max(codes) AS max_bucket, "
                           f"{G('sum(codes) / count(*)')} AS mean_bucket, {G('max(codes) * count(*) / sum(codes)')} AS skew, (sum(codes) * 8 + count(*) * 4)::BIGINT AS logical_bytes FROM buckets GROUP BY t",
        # evaluation
        "classification_metrics": f"{P2} SELECT model, tp, fp, fn, tn, {RATES}, total_samples, anomalies_detected, true_anomalies FROM metrics",
        "roc_auc": f"{P2} SELECT model, {G('roc_auc')} AS roc_auc FROM auc",
        "confusion_matrix": f"{P2} SELECT model, label, sum(1 - is_anomaly::INT)::BIGINT AS predicted_normal, sum(is_anomaly::INT)::BIGINT AS predicted_anomaly FROM predictions GROUP BY model, label",
        "anomaly_rate": f"{P2} SELECT model, sum(is_anomaly::INT)::BIGINT AS anomalies_detected, count(*) AS total_samples, {G('sum(is_anomaly::INT) / count(*) * 100')} AS anomaly_rate FROM predictions GROUP BY model",
        # analysis
        "feature_profile": f"{ALL} {profile_rows(FEATURES)}",
        "feature_corr_matrix": f"{ALL} SELECT feature_a, feature_b, {G('correlation')} AS correlation FROM ({corr_pairs(FEATURES)})",
        "redundant_pairs": f"{ALL}, m AS ({corr_pairs(FEATURES)}) SELECT feature_a, feature_b, {G('correlation')} AS correlation FROM m "
                           f"WHERE correlation > 0.9e0 AND list_position({list(FEATURES)}, feature_a) < list_position({list(FEATURES)}, feature_b)",
        "feature_code_corr": f"{V1}, joined AS (SELECT f.*, c.embedding FROM train_features f JOIN train_codes c USING (id)) "
                             + " UNION ALL ".join(f"SELECT '{n}' AS feature, {G(f'abs(coalesce(corr({n}::DOUBLE, embedding::DOUBLE), 0))')} AS correlation FROM joined" for n in FEATURES),
        "embedding_histogram": histogram(V1, "SELECT embedding AS v FROM train_codes", 50),
        "feature_ablation": f"{ablation_chain()} SELECT {ABLATION_COLUMNS} FROM ablation",
        "top_features": f"{ablation_chain()} SELECT {ABLATION_COLUMNS} FROM ablation ORDER BY f1_drop DESC, removed_feature LIMIT 10",
        "scaled_features": f"{ALL} {scaled(OPTIMIZED_FEATURES, 'feats')}",
    }
    q["run_history"] = q["run_performance"]
    q["stream_score"] = q["prediction_detail"]
    q["stream_replay"] = (
        f"{P2}, chosen AS (SELECT id FROM flows WHERE split = 'test' ORDER BY {S.seeded('42')}, id LIMIT 1000), "
        f"numbered AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 100 AS batch FROM chosen) "
        f"SELECT p.id, model, is_anomaly::INT AS prediction, {G('score')} AS score, label AS true_label, is_anomaly::INT = label AS correct, "
        f"count(*) OVER (PARTITION BY batch) AS batch_rows FROM predictions p JOIN numbered n ON n.id = p.id"
    )
    q["stream_metrics"] = (
        f"{P2} SELECT model, total_samples AS flows_processed, anomalies_detected, "
        f"{G('anomalies_detected / total_samples')} AS detection_share, {G('accuracy')} AS accuracy FROM metrics"
    )
    seeds = seeds_chain()
    spread = ", ".join(f'{G(f"""avg("{m}")""")} AS {m}_mean, {G(f"""stddev_pop("{m}")""")} AS {m}_std' for m in (*RATE_COLUMNS, "roc_auc"))
    q["metrics_over_seeds"] = f"{seeds} SELECT model, {spread} FROM full_metrics GROUP BY model"
    q["metric_long_summary"] = seeds + " " + " UNION ALL ".join(
        f"SELECT model, '{m}' AS metric, {G(f'avg({chr(34)}{m}{chr(34)})')} AS mean, {G(f'stddev_pop({chr(34)}{m}{chr(34)})')} AS std FROM full_metrics GROUP BY model"
        for m in (*RATE_COLUMNS, "roc_auc")
    )
    per_minute = "SELECT date_trunc('minute', ts) AS minute, count(*) AS anomalies FROM predictions WHERE is_anomaly GROUP BY 1"
    q["anomaly_rate_per_minute"] = (
        f"{P2} SELECT minute, anomalies, {G('avg(anomalies) OVER (ORDER BY minute ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)')} AS recent_rate FROM ({per_minute})"
    )
    q["anomaly_history"] = f"{P2} SELECT model AS detected_by_model, count(*) AS total_anomalies, max(ts) AS last_anomaly FROM predictions WHERE is_anomaly GROUP BY model"
    return q
