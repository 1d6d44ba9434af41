"""The same steps as DuckDB SQL text, for checking results on whole tables.

``chain(...)`` returns a ``WITH`` clause; DuckDB evaluates only the parts that
the final SELECT reads.
"""

from __future__ import annotations

from flowsift.operators.lsh import HashFamily
from flowsift.schema import (
    FEATURES, LSH_V1, LSH_V2, OPTIMIZED_FEATURES, QUANTIZER_V1, QUANTIZER_V2,
    LshSpec, QuantizerSpec,
)
from flowsift.sources.flows import TRAIN_UNTIL

FLOWS = f"""
e AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
  FROM events
), b AS (
  SELECT *, CAST(1 + k AS BIGINT) AS spkts, CAST((event_id * 7) % 40 AS BIGINT) AS dpkts,
         CASE WHEN event_id % 50 = 0 THEN 0.0e0 ELSE value * value / 10000.0e0 END AS dur
  FROM e
), c AS (
  SELECT *, CAST(floor(value * spkts) AS BIGINT) AS sbytes, CAST(dpkts * (40 + user_id) AS BIGINT) AS dbytes
  FROM b
), flows AS (
  SELECT event_id AS id, ts, dur,
    CASE k % 5 WHEN 0 THEN 'UDP' WHEN 1 THEN 'icmp' WHEN 2 THEN 'arp' ELSE 'tcp' END AS proto,
    CASE WHEN user_id % 13 = 0 THEN '-' ELSE concat('svc', CAST(user_id % 13 AS VARCHAR)) END AS service,
    event_type AS state, spkts, dpkts, sbytes, dbytes,
    CASE WHEN dur > 0 THEN (spkts + dpkts) / dur ELSE 0.0e0 END AS rate,
    CAST(CASE WHEN k % 2 = 0 THEN 254 ELSE 62 END AS INT) AS sttl,
    CAST(CASE WHEN event_id % 2 = 0 THEN 252 ELSE 0 END AS INT) AS dttl,
    CASE WHEN dur > 0 THEN sbytes * 8 / dur ELSE 0.0e0 END AS sload,
    CASE WHEN dur > 0 THEN dbytes * 8 / dur ELSE 0.0e0 END AS dload,
    CASE WHEN event_id % 97 = 0 THEN '-' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS smean,
    CAST(user_id % 3 AS INT) AS trans_depth, CAST(1 + k % 10 AS INT) AS ct_src_dport_ltm,
    CAST(1 + user_id % 6 AS INT) AS ct_dst_sport_ltm,
    CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INT) AS label,
    CASE WHEN ts < DATE '{TRAIN_UNTIL}' THEN 'train' ELSE 'test' END AS split
  FROM c
)"""


def grid(expr: str, step: str = "1e6") -> str:
    return f"floor(({expr}) * {step} + 0.5e0) / {step}"


def seeded(seed: str, ident: str = "id") -> str:
    return f"md5(concat(CAST({seed} AS VARCHAR), ':', CAST({ident} AS VARCHAR)))"


def features(name: str, source: str, vocab: str | None = None) -> str:
    """CTE ``name``: run, id, label, ts and the 22 features of ``source``."""
    vocab = vocab or source
    return f"""
{name}_service AS (
  SELECT run, value, row_number() OVER (PARTITION BY run ORDER BY pos, value) AS code
  FROM (SELECT run, lower(service) AS value, min(id) AS pos FROM {vocab} GROUP BY ALL)
), {name}_state AS (
  SELECT run, value, row_number() OVER (PARTITION BY run ORDER BY pos, value) AS code
  FROM (SELECT run, upper(state) AS value, min(id) AS pos FROM {vocab} GROUP BY ALL)
), {name}_raw AS (
  SELECT f.run, f.id, f.label, f.ts, f.dur AS duration, f.sbytes AS src_bytes, f.dbytes AS dst_bytes,
    f.spkts AS src_packets, f.dpkts AS dst_packets,
    CASE lower(f.proto) WHEN 'tcp' THEN 1 WHEN 'udp' THEN 2 WHEN 'icmp' THEN 3 ELSE 1 END::BIGINT AS protocol,
    coalesce(s.code, 0)::BIGINT AS service_encoded, coalesce(t.code, 0)::BIGINT AS state_encoded,
    f.sload AS src_load, f.dload AS dst_load,
    CASE WHEN f.smean IN ('-', '', 'nan') THEN 0.0e0 ELSE coalesce(try_cast(f.smean AS DOUBLE), 0.0e0) END AS mean_packet_size,
    f.trans_depth::BIGINT AS trans_depth, f.ct_src_dport_ltm::BIGINT AS ct_src_dport_ltm,
    f.ct_dst_sport_ltm::BIGINT AS ct_dst_sport_ltm
  FROM {source} f
  LEFT JOIN {name}_service s ON s.run = f.run AND s.value = lower(f.service)
  LEFT JOIN {name}_state t ON t.run = f.run AND t.value = upper(f.state)
), {name}_sum AS (
  SELECT *, src_bytes + dst_bytes AS total_bytes, src_packets + dst_packets AS total_packets FROM {name}_raw
), {name} AS (
  SELECT run, id, label, ts, duration, src_bytes, dst_bytes, src_packets, dst_packets, protocol, service_encoded,
    state_encoded, total_bytes, total_packets,
    CASE WHEN total_packets > 0 THEN total_bytes / total_packets ELSE 0.0e0 END AS bytes_per_packet,
    CASE WHEN duration > 0 THEN total_bytes / duration ELSE 0.0e0 END AS bytes_per_second,
    CASE WHEN duration > 0 THEN total_packets / duration ELSE 0.0e0 END AS packets_per_second,
    CASE WHEN total_bytes > 0 THEN src_bytes / total_bytes ELSE 0.5e0 END AS src_bytes_ratio,
    CASE WHEN total_packets > 0 THEN src_packets / total_packets ELSE 0.5e0 END AS src_packets_ratio,
    src_load, dst_load,
    CASE WHEN dst_load > 0 THEN src_load / dst_load ELSE 0.0e0 END AS load_ratio,
    mean_packet_size, trans_depth, ct_src_dport_ltm, ct_dst_sport_ltm
  FROM {name}_sum
)"""


def lerp(low: str, high: str, weight: str) -> str:
    return f"CASE WHEN {weight} >= 0.5e0 THEN {high} - ({high} - {low}) * (1.0e0 - {weight}) ELSE {low} + ({high} - {low}) * {weight} END"


def _case(spec: QuantizerSpec, pick, default: str) -> str:
    arms = " ".join(f"WHEN '{f}' THEN {pick(f)}" for f in spec.features)
    return f"CASE feature {arms} ELSE {default} END"


def unpivot(source: str, names: tuple[str, ...], keep: str = "run, id") -> str:
    cast = ", ".join(f"{n}::DOUBLE AS {n}" for n in names)
    return (f"SELECT {keep}, feature, value FROM (SELECT {keep}, {cast} FROM {source}) "
            f"UNPIVOT (value FOR feature IN ({', '.join(names)}))")


def quantizer(train: str, spec: QuantizerSpec) -> str:
    """CTEs long, ranks, summary, trims, grid, params of the ``train`` features."""
    keep = "WHERE value <> 0" if spec.drop_zeros else ""
    kind = _case(spec, lambda f: f"'{'categorical' if f in spec.categorical else spec.rule(f).kind}'", "'plain'")
    bits = _case(spec, lambda f: str(spec.rule(f).bits), str(spec.default_rule.bits))
    linear = _case(spec, lambda f: str(spec.rule(f).bits_linear), "0")
    cats = ", ".join(f"'{f}'" for f in spec.categorical)
    return f"""
long AS ({unpivot(train, spec.features)}),
ranks AS MATERIALIZED (
  SELECT run, feature, value, row_number() OVER (PARTITION BY run, feature ORDER BY value) - 1 AS rk
  FROM long {keep}
), summary0 AS (
  SELECT run, feature, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std,
    CASE WHEN feature IN ({cats}) THEN list_sort(list(DISTINCT value)) END AS categories
  FROM ranks GROUP BY run, feature HAVING count(*) >= {spec.min_support}
), summary1 AS (
  SELECT *, {kind} AS kind0 FROM summary0
), summary AS (
  SELECT run, feature, n, categories,
    CASE WHEN kind0 <> 'dispersion' THEN kind0 WHEN std > mean THEN 'log' ELSE 'linear' END AS kind,
    CASE WHEN kind0 = 'categorical' THEN least(greatest(length(bin(len(categories))), {spec.min_category_bits}), {spec.max_category_bits})
         WHEN kind0 = 'dispersion' AND NOT std > mean THEN {linear}
         ELSE {bits} END::INT AS bits
  FROM summary1
), end_goals AS (
  SELECT run, feature, q, (n - 1) * q AS place, unnest([0, 1]) AS side, n
  FROM (SELECT *, unnest([1 / 100.0e0, 99 / 100.0e0]) AS q FROM summary WHERE kind = 'trimmed')
), end_ranks AS (
  SELECT *, least(floor(place)::BIGINT + side, n - 1) AS rk FROM end_goals
), ends AS (
  SELECT g.run, g.feature, g.q, g.place, max(CASE WHEN side = 0 THEN r.value END) AS low, max(CASE WHEN side = 1 THEN r.value END) AS high
  FROM end_ranks g JOIN ranks r ON r.run = g.run AND r.feature = g.feature AND r.rk = g.rk GROUP BY ALL
), trim_limits AS (
  SELECT run, feature,
    max(CASE WHEN q < 0.5e0 THEN {lerp('low', 'high', '(place - floor(place))')} END) AS min_val,
    max(CASE WHEN q > 0.5e0 THEN {lerp('low', 'high', '(place - floor(place))')} END) AS max_val
  FROM ends GROUP BY run, feature
), trims AS (
  SELECT run, feature, any_value(min_val) AS min_val, any_value(max_val) AS max_val,
    count(*) FILTER (value < min_val) AS below, count(*) FILTER (value BETWEEN min_val AND max_val) AS kept
  FROM ranks JOIN trim_limits USING (run, feature) GROUP BY run, feature
), goals0 AS (
  SELECT s.run, s.feature, s.kind, coalesce(t.kept, s.n) AS n, coalesce(t.below, 0) AS skip,
    (1 << s.bits) AS levels, unnest(range(1 << s.bits)) AS i
  FROM summary s LEFT JOIN trims t USING (run, feature) WHERE s.kind <> 'categorical'
), goals AS (
  SELECT *, (n - 1) * CASE WHEN i = levels - 1 THEN 1.0e0 ELSE i * (100.0e0 / (levels - 1)) / 100.0e0 END AS place FROM goals0
), goal_sides AS (
  SELECT *, unnest([0, 1]) AS side FROM goals
), goal_ranks AS (
  SELECT *, least(floor(place)::BIGINT + side, n - 1) + skip AS rk FROM goal_sides
), points0 AS (
  SELECT g.run, g.feature, g.i, g.place - floor(g.place) AS weight,
    max(CASE WHEN side = 0 THEN CASE WHEN kind = 'log' THEN log10(r.value + 1) ELSE r.value END END) AS low,
    max(CASE WHEN side = 1 THEN CASE WHEN kind = 'log' THEN log10(r.value + 1) ELSE r.value END END) AS high
  FROM goal_ranks g JOIN ranks r ON r.run = g.run AND r.feature = g.feature AND r.rk = g.rk GROUP BY ALL
), points AS (
  SELECT run, feature, i, {lerp('low', 'high', 'weight')} AS threshold FROM points0
), params AS MATERIALIZED (
  SELECT s.run, s.feature, s.kind,
    CASE s.kind WHEN 'categorical' THEN 'categorical' WHEN 'log' THEN 'log_continuous'
      WHEN 'trimmed' THEN 'adaptive_continuous' ELSE 'continuous' END AS type,
    s.bits, s.n AS n_values, p.thresholds, CASE WHEN s.kind = 'categorical' THEN s.categories END AS categories,
    t.min_val, t.max_val
  FROM summary s
  LEFT JOIN (SELECT run, feature, list(threshold ORDER BY i) AS thresholds FROM points GROUP BY run, feature) p USING (run, feature)
  LEFT JOIN trims t USING (run, feature)
)"""


def bins(name: str, source: str, names: tuple[str, ...]) -> str:
    """CTE ``name``: run, id, feature, bin."""
    moved = ("CASE WHEN p.type = 'log_continuous' THEN log10(l.value + 1) "
             "WHEN p.min_val IS NOT NULL THEN least(greatest(l.value, p.min_val), p.max_val) ELSE l.value END")
    return f"""
{name}_long AS ({unpivot(source, names)}),
{name}_moved AS (
  SELECT l.run, l.id, l.feature, l.value, {moved} AS moved, p.thresholds, p.categories, p.type
  FROM {name}_long l LEFT JOIN params p USING (run, feature)
), {name} AS MATERIALIZED (
  SELECT run, id, feature,
    CASE WHEN type IS NULL THEN 0
         WHEN type = 'categorical' THEN greatest(coalesce(list_position(categories, value), 0) - 1, 0)
         ELSE least(len(list_filter(thresholds, lambda x: x < moved)), len(thresholds) - 1) END::BIGINT AS bin
  FROM {name}_moved
)"""


def layout(orders: dict[int, tuple[str, ...]], code_bits: int, shared_params: bool = False) -> str:
    """CTE ``shifts``: run, feature, shift of each feature that fits in the code.

    ``orders`` gives the feature order of each run; with ``shared_params`` all
    runs take the bits of run 0.
    """
    rows = ", ".join(f"({r}, {i}, '{f}')" for r, order in orders.items() for i, f in enumerate(order, 1))
    run = "0" if shared_params else "v.run"
    return f"""
feature_order(run, i, feature) AS (VALUES {rows}),
order_bits AS MATERIALIZED (
  SELECT v.run, v.i, v.feature, coalesce(p.bits, 2) AS bits FROM feature_order v LEFT JOIN params p ON p.feature = v.feature AND p.run = {run}
), fill AS (
  SELECT DISTINCT run, 0 AS i, 0 AS used, 0 AS width FROM order_bits
  UNION ALL
  SELECT f.run, o.i, f.used + CASE WHEN f.used + o.bits <= {code_bits} THEN o.bits ELSE 0 END,
    CASE WHEN f.used + o.bits <= {code_bits} THEN o.bits ELSE 0 END
  FROM fill f JOIN order_bits o ON o.run = f.run AND o.i = f.i + 1
), shifts AS MATERIALIZED (
  SELECT o.run, o.feature, t.total - f.used AS shift
  FROM fill f JOIN order_bits o ON o.run = f.run AND o.i = f.i
  JOIN (SELECT run, max(used) AS total FROM fill GROUP BY run) t ON t.run = f.run WHERE f.width > 0
)"""


def codes(name: str, binned: str) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT run, id, bit_or(bin << shift) AS embedding FROM {binned} JOIN shifts USING (run, feature) GROUP BY run, id
)"""


def masks(families: dict[int, HashFamily]) -> str:
    rows = []
    for run, family in families.items():
        for t, table in enumerate(family.masks):
            for f, mask in enumerate(table):
                signed = mask - (1 << 64) if mask >> 63 else mask
                rows.append(f"({run},{t},{f},({signed})::BIGINT)")
    return f"masks(run, t, f, mask) AS (VALUES {','.join(rows)})"


def keys(name: str, source: str, code: str = "embedding") -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT c.run, c.{code} AS code, m.t, sum((bit_count(c.{code} & m.mask) % 2)::BIGINT << m.f)::BIGINT AS hash_key
  FROM (SELECT DISTINCT run, {code} FROM {source}) c JOIN masks m ON m.run = c.run GROUP BY ALL
)"""


def stats(train_codes: str, seeds: dict[int, int], spec: LshSpec, where: str = "") -> str:
    seed = "CASE run " + " ".join(f"WHEN {r} THEN {s}" for r, s in seeds.items()) + " END"
    threshold = "mean + 2 * std" if spec.version == "v1" else "greatest(mean - 2 * std, p[2])"
    return f"""
picked AS (
  SELECT run, embedding, row_number() OVER (PARTITION BY run ORDER BY {seeded(seed)}, id) - 1 AS rn FROM {train_codes}
), sample AS (SELECT * FROM picked WHERE rn < {spec.sample}),
band AS (
  SELECT a.run, bit_count(xor(a.embedding, b.embedding))::INT AS d FROM sample a
  JOIN sample b ON a.run = b.run AND b.rn BETWEEN a.rn + 1 AND a.rn + {spec.band} WHERE a.rn < {spec.anchors}
), stats0 AS (
  SELECT run, avg(d) AS mean, stddev_pop(d) AS std, quantile_cont(d::DOUBLE, [0.1, 0.25, 0.5, 0.75, 0.9]) AS p FROM band GROUP BY run
), stats AS (
  SELECT run, mean, std, p[1] AS p10, p[2] AS p25, p[3] AS p50, p[4] AS p75, p[5] AS p90, {threshold} AS threshold FROM stats0
)"""


def neighbours(train_codes: str, query_codes: str, spec: LshSpec) -> str:
    """CTEs index, pairs, probe pairs and ``knn`` for the distinct query codes."""
    probe = f"""
missed AS (SELECT DISTINCT run, code FROM qkeys EXCEPT SELECT run, q FROM pairs),
firsts AS (
  SELECT run, t, hash_key, row_number() OVER (PARTITION BY run, t ORDER BY min(first_pos), hash_key) AS rank
  FROM idx WHERE t < {max(spec.probe_tables, 0)} GROUP BY run, t, hash_key
), probed AS (
  SELECT DISTINCT q.run, q.code AS q, i.code AS c
  FROM missed m JOIN qkeys q ON q.run = m.run AND q.code = m.code
  JOIN firsts k ON k.run = q.run AND k.t = q.t AND k.rank <= {spec.probe_keys}
    AND bit_count(xor(k.hash_key, q.hash_key)) <= {spec.probe_bits}
  JOIN idx i ON i.run = k.run AND i.t = k.t AND i.hash_key = k.hash_key
)"""
    return f"""
{keys('ikeys', train_codes)},
idx AS MATERIALIZED (
  SELECT k.run, k.t, k.hash_key, k.code, d.n_flows, d.first_pos
  FROM ikeys k JOIN (SELECT run, embedding, count(*) AS n_flows, min(id) AS first_pos FROM {train_codes} GROUP BY ALL) d
    ON d.run = k.run AND d.embedding = k.code
),
{keys('qkeys', query_codes)},
pairs AS MATERIALIZED (
  SELECT DISTINCT q.run, q.code AS q, i.code AS c FROM qkeys q JOIN idx i ON i.run = q.run AND i.t = q.t AND i.hash_key = q.hash_key
), {probe},
every AS (SELECT *, false AS probed FROM pairs UNION ALL SELECT *, true FROM probed),
ordered AS (
  SELECT run, q, probed, bit_count(xor(q, c))::INT AS d, row_number() OVER (PARTITION BY run, q ORDER BY bit_count(xor(q, c))) AS rk,
    count(*) OVER (PARTITION BY run, q) AS candidates FROM every
), top AS (
  SELECT run, q, any_value(candidates) AS candidates, min(d) AS min_distance, count(*) AS k, avg(d) AS avg_distance, any_value(probed) AS probed
  FROM ordered WHERE rk <= {spec.neighbours} GROUP BY run, q
), knn AS (
  SELECT c.run, c.embedding, coalesce(t.candidates, 0) AS candidates, t.min_distance, coalesce(t.k, 0) AS k, t.avg_distance, coalesce(t.probed, false) AS probed
  FROM (SELECT DISTINCT run, embedding FROM {query_codes}) c LEFT JOIN top t ON t.run = c.run AND t.q = c.embedding
)"""


def verdict(query_codes: str, spec: LshSpec) -> str:
    """CTE ``verdict``: run, id, embedding, is_anomaly, score."""
    size = f"{spec.code_bits}.0e0"
    if spec.version == "v1":
        flag = "avg_distance > threshold"
        none_score = "1.0e0"
        score = f"least(avg_distance / ({size} * 0.75e0), 1.0e0)"
    else:
        conditions = [
            ("min_distance > threshold", f"0.7e0 + 0.3e0 * (min_distance / {size})"),
            ("avg_distance > threshold * 1.1e0", f"0.6e0 + 0.4e0 * (avg_distance / {size})"),
            ("candidates < 5", "0.75e0"),
            ("min_distance > p75", "0.65e0"),
        ]
        flag = " OR ".join(f"({c})" for c, _ in conditions)
        none_score = "0.90e0"
        score = "least(greatest(" + ", ".join(f"CASE WHEN {c} THEN {s} ELSE 0.0e0 END" for c, s in conditions) + "), 1.0e0)"
    return f"""
verdict AS (
  SELECT c.run, c.id, c.embedding, n.candidates,
    CASE WHEN n.candidates = 0 THEN true ELSE {flag} END AS is_anomaly,
    CASE WHEN n.candidates = 0 THEN {none_score} ELSE {score} END AS score
  FROM {query_codes} c JOIN knn n ON n.run = c.run AND n.embedding = c.embedding JOIN stats s ON s.run = c.run
)"""


def chain(version: str, seeds: dict[int, int], train: str, test: str) -> str:
    """All CTEs from flows to verdict; ``train`` and ``test`` are SELECTs with a run column."""
    spec, lsh, names = (QUANTIZER_V1, LSH_V1, FEATURES) if version == "v1" else (QUANTIZER_V2, LSH_V2, OPTIMIZED_FEATURES)
    families = {r: HashFamily.draw(s, lsh) for r, s in seeds.items()}
    order = spec.priority
    return "WITH RECURSIVE " + ",".join([
        FLOWS, f"train AS ({train})", f"test AS ({test})",
        features("train_features", "train"), features("test_features", "test", "train"),
        quantizer("train_features", spec),
        bins("train_bins", "train_features", order), bins("test_bins", "test_features", order),
        layout({r: order for r in seeds}, spec.code_bits), codes("train_codes", "train_bins"), codes("test_codes", "test_bins"),
        masks(families), stats("train_codes", seeds, lsh),
        neighbours("train_codes", "test_codes", lsh), verdict("test_codes", lsh),
    ])
