"""Exact and approximate vector searches against brute force."""

import numpy as np

from flowsift.llm import graphs, pivots
from flowsift.llm.vectors import clean_vectors

ODD = [(None, [1.0, 2.0]), (60, None), (80, [1.0, float("nan")]), (81, [float("inf"), 0.0]), (82, [None, 1.0]), (83, []), (84, [0.0, 0.0])]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "extra", 5) for r in rows], "vec_id long, embedding array<float>, score string, rank int")


def data(n=700, width=8, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, width)).astype(np.float32) / 3) if i not in (60, 80, 81, 82, 83, 84)]
    same = rows[5][1]
    return rows + [(i, same) for i in range(10_000, 10_120)] + [rows[7], rows[40]]  # copies under other ids, and repeated rows


def brute(rows, score, k):
    rows = {i: v for i, v in rows}
    out = {}
    for q in rows:
        if q % 20 == 0:
            found = sorted(((-score(rows[q], v), i) for i, v in rows.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_exact_top_k(spark):
    rows = data()
    whole = [(i, [float(np.floor(np.float64(np.float32(x)) * 64)) for x in v]) for i, v in [*rows, (83, []), (84, [0.0] * 8)]]
    pad = lambda v: np.array([*v, *[0.0] * (8 - len(v))])
    expected = brute(whole, lambda a, b: int(pad(a) @ pad(b)), 20)
    vectors = pivots.integer_vectors(frame(spark, rows + ODD))
    got = pivots.pivot_top_k(vectors, pivots=5, sample=200, block_rows=16, batch_rows=8, first=2, part_blocks=4)
    assert collected(got) == expected


def test_few_and_no_vectors(spark):
    few = frame(spark, [(0, [0.5, 1.0]), (20, [0.5, 1.0]), (3, [-1.0, 2.0])])
    expected = {0: [(20, 32 * 32 + 64 * 64), (3, -64 * 32 + 128 * 64)], 20: [(0, 32 * 32 + 64 * 64), (3, -64 * 32 + 128 * 64)]}
    got = collected(pivots.pivot_top_k(pivots.integer_vectors(few)))
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in expected.items()}
    assert pivots.pivot_top_k(pivots.integer_vectors(frame(spark, []))).collect() == []
    assert graphs.graph_neighbours(clean_vectors(frame(spark, ODD))).collect() == []
    near = collected(graphs.graph_neighbours(clean_vectors(few)))
    assert [v for v, _ in near[0]] == [3, 20]


def test_graph_recall(spark):
    rows = data(1500, 12, seed=4)
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    expected = brute(list(vectors.items()), lambda a, b: float(a @ b), 20)
    got = collected(graphs.graph_neighbours(clean_vectors(frame(spark, rows + ODD)), shard_rows=400))
    assert got.keys() == expected.keys()
    hits = 0
    for q, found in got.items():
        assert len(found) == 20
        assert [v for v, _ in found] == [v for v, _ in sorted(found, key=lambda x: (-x[1], x[0]))]
        assert all(abs(s - vectors[q] @ vectors[v]) < 1e-12 for v, s in found)
        hits += len({v for v, _ in found} & {v for v, _ in expected[q]})
    assert hits / (20 * len(got)) >= 0.9


def test_large_components(spark):
    """Vectors beyond the index's range are searched all the same, in both directions; scores end at those of a long."""
    rows = data(100, 4, seed=9) + [(1000, [2e6, 1.0]), (1001, [-3e7, 5.0, 1.0]), (1020, [1e30, -1.0]), (1040, [4e6, 4e6, 1.0, 2.0]), (1041, [1e37])]
    whole = [(i, [int(np.floor(np.float64(np.float32(x)) * 64)) for x in v] + [0] * (4 - len(v))) for i, v in rows]
    expected = brute(whole, lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True)))), 20)
    vectors = pivots.integer_vectors(frame(spark, rows + ODD[:5]))
    assert collected(pivots.pivot_top_k(vectors, pivots=5, sample=50, block_rows=16, batch_rows=8)) == expected
    only = pivots.integer_vectors(frame(spark, [(0, [2e6, 1.0]), (1, [1.0, 1.0]), (20, [1.0, 2.0])]))
    assert {q: [v for v, _ in found] for q, found in collected(pivots.pivot_top_k(only)).items()} == {0: [20, 1], 20: [0, 1]}
    alone = pivots.integer_vectors(frame(spark, [(0, [2e6]), (20, [3e6])]))
    assert collected(pivots.pivot_top_k(alone)) == {0: [(20, 128_000_000 * 192_000_000)], 20: [(0, 128_000_000 * 192_000_000)]}
