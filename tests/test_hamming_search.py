"""Multi-index hashing against all pairs, with hot codes and hot part values."""

import numpy as np
import pytest

from flowsift.operators import hamming_search, lsh
from flowsift.schema import LSH_V2


def frame(spark, codes):
    return spark.createDataFrame([(int(c), 1) for c in codes], "embedding bigint, x int")


def brute(queries, index, k):
    known = np.unique(index).view(np.uint64)
    out = {}
    for q in np.unique(queries):
        d = np.sort(np.bitwise_count(known ^ np.uint64(q.view(np.uint64))).astype(int))[:k]
        if len(d):
            out[int(q)] = (len(d), d[0], d[-1], d.mean())
    return out


def near(n, seed, flips):
    rng = np.random.RandomState(seed)
    codes = np.full(n, 0x8234567890ABCDEF, np.uint64)
    for _ in range(flips):
        codes = codes ^ (np.uint64(1) << rng.randint(0, 64, n).astype(np.uint64))
    return codes.view(np.int64)


def far(n, seed):
    return np.random.RandomState(seed).randint(-(2**62), 2**62, n)


@pytest.mark.parametrize("cell", [hamming_search.CELL, 7])
def test_all_pairs(spark, monkeypatch, cell):
    """Near and far queries, negative codes, a code on half of all rows, and one part value shared by most codes."""
    monkeypatch.setattr(hamming_search, "CELL", cell)
    hot = np.full(400, -5, np.int64)
    shared = (np.int64(77) << 48) | far(60, 4) & np.int64(2**40 - 1)
    index = np.concatenate([near(150, 1, 5), far(60, 2), shared, hot])
    queries = np.concatenate([near(20, 3, 9), far(5, 5), shared[:20] ^ 3, hot[:50]])
    got = {r.embedding: r for r in hamming_search.exact_knn(frame(spark, queries), frame(spark, index), 20).collect()}
    want = brute(queries, index, 20)
    assert set(got) == set(want)
    for q, (k, low, high, mean) in want.items():
        r = got[q]
        assert (r.k, r.min_distance, r.kth_distance) == (k, low, high) and abs(r.avg_distance - mean) < 1e-12


def test_few_and_no_codes(spark):
    index = frame(spark, [0, -1, -1])
    got = {r.embedding: (r.k, r.min_distance, r.kth_distance) for r in hamming_search.exact_knn(frame(spark, [0, 5]), index, 20).collect()}
    assert got == {0: (2, 0, 64), 5: (2, 2, 62)}
    nothing = index.where("false")
    assert hamming_search.exact_knn(index, nothing, 20).count() == 0 and hamming_search.exact_knn(nothing, index, 20).count() == 0


def test_pairs_are_not_shuffled(spark):
    """A round's exchanges carry codes, part values and counts; the join's result is summed before it moves."""
    q, i = frame(spark, near(50, 1, 3)).select("embedding"), frame(spark, near(50, 2, 3)).select("embedding")
    plan = hamming_search._round(q, i, 1, 1, True)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_recall(spark):
    train, test = near(300, 7, 4), near(60, 8, 5)
    model = lsh.fit_lsh(spark.createDataFrame([(i, int(c)) for i, c in enumerate(train)], "id bigint, embedding bigint"), 42, LSH_V2)
    queries = model.hash(spark.createDataFrame([(0, int(c)) for c in np.unique(test)], "run int, embedding bigint"))
    rows = hamming_search.index_recall(model, queries, 10).collect()
    want = brute(test, train, 10)
    assert sum(r.true_neighbours for r in rows) == sum(k for k, *_ in want.values())
    assert all(0 <= r.found <= r.true_neighbours and r.recall == r.found / r.true_neighbours for r in rows)
    assert [r.recall for r in rows if r.distance == 0] in ([], [1.0])  # equal codes share every bucket


def test_far_queries_meet_codes_in_blocks(spark, monkeypatch):
    """Far queries run no round: all codes are compared in blocks, within the distance that growing shares give."""
    def no_round(*_):
        raise AssertionError("a round that names nearly all pairs")

    monkeypatch.setattr(hamming_search, "_round", no_round)
    for name, value in {"FIRST_SHARE": 30, "SHARE_STEP": 3, "TASK_QUERIES": (9, 20), "TASK_CODES": (40, 100), "TILE": (4, 16)}.items():
        monkeypatch.setattr(hamming_search, name, value)
    index, queries = np.concatenate([near(200, 1, 12), far(300, 2), np.full(50, -5, np.int64)]), np.concatenate([near(40, 3, 14), far(20, 5)])
    got = {r.embedding: r for r in hamming_search.exact_knn(frame(spark, queries), frame(spark, index), 20).collect()}
    want = brute(queries, index, 20)
    assert set(got) == set(want)
    for q, (k, low, high, mean) in want.items():
        r = got[q]
        assert (r.k, r.min_distance, r.kth_distance) == (k, low, high) and abs(r.avg_distance - mean) < 1e-12


def test_blocks_skip_far_pairs(monkeypatch):
    """A block looks at a small part of its pairs when the bounds are tight, and at all of them when they are not."""
    import pyarrow as pa

    index, queries = np.unique(far(20_000, 1)), np.unique(np.concatenate([far(20_000, 1)[:1500] ^ 5, far(500, 3)]))
    bounds = np.resize([4, 4, 2, 64], len(queries)).astype(np.int32)
    bounds[1000:] = 3
    looked, xor = [], np.bitwise_xor
    monkeypatch.setattr(np, "bitwise_xor", lambda a, b, out: looked.append(out.size) or xor(a, b, out=out))

    def counted(which):
        rows = pa.RecordBatch.from_arrays([pa.array([queries[which]]), pa.array([bounds[which]]), pa.array([index])], ["query", "bound", "known"])
        looked.clear()
        out = list(hamming_search._compare(*hamming_search.TILE)(iter([rows])))
        return {(q, d): n for b in out for q, d, n in zip(*(c.to_pylist() for c in b.columns))}

    def want(which):
        out = {}
        for q, bound in zip(queries[which], bounds[which]):
            d = np.bitwise_count((index ^ q).view(np.uint64))
            out |= {(int(q), int(x)): int(n) for x, n in zip(*np.unique(d[d <= bound], return_counts=True))}
        return out

    tight = bounds < 64
    assert counted(tight) == want(tight) and sum(looked) < tight.sum() * len(index) / 4
    assert counted(np.arange(60)) == want(np.arange(60))


def test_recall_in_blocks(spark, monkeypatch):
    """The recall of a large index, whose bucket-mates are compared in blocks, is that of a small one."""
    train, test = near(200, 7, 4), near(40, 8, 5)
    model = lsh.fit_lsh(spark.createDataFrame([(i, int(c)) for i, c in enumerate(train)], "id bigint, embedding bigint"), 42, LSH_V2)
    queries = model.hash(spark.createDataFrame([(0, int(c)) for c in np.unique(test)], "run int, embedding bigint"))
    small = sorted(hamming_search.index_recall(model, queries, 10).collect())
    monkeypatch.setattr(lsh, "BROADCAST_INDEX_ROWS", 10)
    assert sorted(hamming_search.index_recall(model, queries, 10).collect()) == small and small
