"""Approximate nearest neighbours (largest inner product) by robust-pruned directed graphs.

Vectors are dealt into shards of about ``shard_rows`` by a hash of the id; every row is indexed.
A shard's graph is built in its own task, batch by batch: a greedy search from the entry
proposes neighbours, relaxed distance pruning (a candidate goes if a chosen neighbour is
``alpha`` times nearer to it than the node) keeps diverse edges, and edges are added
backwards and pruned again. All queries search every shard with a beam; results
are scored exactly on the original vectors in double precision, then merged.

Inner products are searched as distances: vectors get one more component that makes all of them equally long.
Equal vectors are one node, which knows its ``k + 1`` smallest ids: no others can be in a result.
Queries (every row whose id is divisible by ``every``) go in batches to all shards.

Recall against brute force is measured in the tests: at least 0.9.

Defined results: null, zero and non-finite vectors and null ids take no part; shorter
vectors count as padded with zeros; rows that share an id are one vector (that which sorts
last); ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsift.llm.neardup import by_key
from flowsift.llm.scratch import ship, written
from flowsift.llm.vectors import best, chunks, clean_vectors, dense


def beam_search(
    x: np.ndarray, edges: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int, step: int = 4
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances (nearest first) of the beam of each query; -1 where it isn't full.

    Every step expands the ``step`` nearest open nodes of each query at once.
    """
    m, n = len(queries), len(x)
    norms, q_norms = (x**2).sum(1), (queries**2).sum(1)[:, None]
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    rows = np.arange(m)[:, None]
    ids = np.full((m, beam), n, np.int64)
    far = np.full((m, beam), np.inf, np.float32)
    start = np.broadcast_to(entry[:beam], (m, min(beam, len(entry))))
    ids[:, : start.shape[1]] = start
    far[:, : start.shape[1]] = q_norms + norms[start] - 2 * np.einsum("md,mkd->mk", queries, x[start])
    seen[rows, start] = True
    order = far.argsort(1, kind="stable")
    ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
    open_ = ids < n
    while True:
        live = np.flatnonzero(open_.any(1))
        if not len(live):
            break
        at = np.argsort(~open_[live], axis=1, kind="stable")[:, :step]
        usable = np.take_along_axis(open_[live], at, 1)
        nodes = np.where(usable, ids[live[:, None], at], n)
        open_[live[:, None], at] = False
        new = edges[nodes].reshape(len(live), -1)
        new = np.sort(np.where(seen[live[:, None], new], n, new), axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        width = int((new < n).sum(1).max(initial=0))
        if not width:
            continue
        new = np.sort(new, axis=1)[:, :width]
        real = new < n
        seen[live[:, None], new] = True
        safe = np.where(real, new, 0)
        d = q_norms[live] + norms[safe] - 2 * np.matmul(x[safe], queries[live][:, :, None])[:, :, 0]
        d = np.where(real, d, np.inf).astype(np.float32)
        all_ids = np.concatenate([ids[live], new], 1)
        all_far = np.concatenate([far[live], d], 1)
        all_open = np.concatenate([open_[live], real], 1)
        keep = all_far.argsort(1, kind="stable")[:, :beam]
        ids[live], far[live] = np.take_along_axis(all_ids, keep, 1), np.take_along_axis(all_far, keep, 1)
        open_[live] = np.take_along_axis(all_open, keep, 1)
    return np.where(ids < n, ids, -1), far


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node at most ``degree`` diverse neighbours out of its candidates (-1: none); filled with len(x)."""
    n = len(x)
    cand = np.where((candidates < 0) | (candidates == nodes[:, None]), n, candidates)
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = n
    safe = np.where(cand < n, cand, 0)
    points = x[safe]
    norms = (points**2).sum(2)
    own = x[nodes]
    d = (own**2).sum(1)[:, None] + norms - 2 * np.matmul(points, own[:, :, None])[:, :, 0]
    d = np.where(cand < n, np.maximum(d, 0), np.inf)
    order = d.argsort(1, kind="stable")
    cand, d, norms = (np.take_along_axis(a, order, 1) for a in (cand, d, norms))
    points = np.take_along_axis(points, order[:, :, None], 1)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(points, points.transpose(0, 2, 1))
    alive = np.isfinite(d)
    out = np.full((len(nodes), degree), n, np.int64)
    rows = np.arange(len(nodes))
    for j in range(degree):
        pick = alive.argmax(1)
        some = alive[rows, pick]
        if not some.any():
            break
        out[some, j] = cand[some, pick[some]]
        alive[rows, pick] = False
        alive &= ~(some[:, None] & (alpha * alpha * between[rows, pick] <= d))
    return out


def build_graph(x: np.ndarray, degree: int = 24, beam: int = 48, alpha: float = 1.2, batch: int = 512, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Edges (n + 1 rows of ``degree``, filled with n) and entry nodes of the graph over float32 rows."""
    n = len(x)
    rng = np.random.Generator(np.random.PCG64(seed))
    edges = np.full((n + 1, degree), n, np.int64)
    entry = np.array([((x - x.mean(0)) ** 2).sum(1).argmin()])
    if n <= degree + 1:
        for i in range(n):
            edges[i, : n - 1] = np.delete(np.arange(n), i)
        return edges, entry
    edges[:n, : degree // 2] = rng.integers(0, n, (n, degree // 2))
    for relax in (1.0, alpha):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            nodes = order[k : k + batch]
            near, _ = beam_search(x, edges, entry, x[nodes], beam)
            chosen = robust_prune(x, nodes, np.concatenate([near, np.where(edges[nodes] < n, edges[nodes], -1)], 1), degree, relax)
            edges[nodes] = chosen
            to, src = chosen.ravel(), np.repeat(nodes, degree)
            real = to < n
            to, src = to[real], src[real]
            back = np.argsort(to, kind="stable")
            to, src = to[back], src[back]
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            many = np.diff(np.append(first, len(to)))
            targets = to[first]
            added = np.full((len(targets), int(many.max())), -1)
            added[np.repeat(np.arange(len(targets)), many), np.arange(len(to)) - np.repeat(first, many)] = src
            for j in range(0, len(targets), batch):
                t = targets[j : j + batch]
                joined = np.concatenate([np.where(edges[t] < n, edges[t], -1), added[j : j + batch]], 1)
                joined = np.where((joined[:, :, None] == joined[:, None, :]).argmax(2) == np.arange(joined.shape[1]), joined, -1)
                over = (joined >= 0).sum(1) > degree
                packed = np.sort(np.where(joined < 0, n, joined), 1)[:, :degree]
                edges[t[~over]] = packed[~over]
                if over.any():
                    edges[t[over]] = robust_prune(x, t[over], joined[over], degree, relax)
    return edges, entry


def _lift(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(longest - (x**2).sum(1), 0))[:, None]], 1).astype(np.float32)


def graph_neighbours(
    vectors: DataFrame, k: int = 20, every: int = 20, shard_rows: int = 4096, degree: int = 24, beam: int = 96, query_rows: int = 2048,
) -> DataFrame:
    """vectors: vec_id, vec (array of double). Returns query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ship(spark)
    squared = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    vectors = written(vectors.where(F.exists("vec", lambda x: x != 0.0)), "vectors")
    copies = Window.partitionBy("vec").orderBy("vec_id")
    nodes = written(
        vectors.withColumn("r", F.row_number().over(copies)).where(F.col("r") <= k + 1)
        .groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")),
        "nodes",
    )
    facts = nodes.agg(F.max(F.size("vec")).alias("width"), F.max(squared).alias("longest"), F.count("*").alias("n")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, longest = facts["width"], float(facts["longest"])
    scale = 1 / np.sqrt(longest) if 0 < longest < np.inf else 1.0
    shards = -(-facts["n"] // shard_rows)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in by_key(batches, ["shard"]):
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                part = table.slice(a, b - a)
                x = dense(part.column("vec"), width)
                edges, entry = build_graph(_lift(x * scale, 1.0), degree)
                ids = part.column("ids").combine_chunks()
                yield pa.record_batch({
                    "shard": part.column("shard").slice(0, 1).combine_chunks(), "vecs": pa.array([x.tobytes()], pa.binary()),
                    "edges": pa.array([edges.astype(np.int32).tobytes()], pa.binary()), "entry": pa.array([entry.astype(np.int64).tobytes()], pa.binary()),
                    "ids": pa.array([ids.flatten().to_numpy().tobytes()], pa.binary()),
                    "many": pa.array([np.diff(ids.offsets.to_numpy()).astype(np.int64).tobytes()], pa.binary()),
                })

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64(F.lit(11), F.col("ids")[0]), F.lit(shards)).cast("int"))
    index = written(
        dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.col("ids")[0])
        .mapInArrow(build, "shard int, vecs binary, edges binary, entry binary, ids binary, many binary"),
        "graphs",
    )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for table in chunks(batches, query_rows):
            yield pa.record_batch({
                "batch": pa.array([name]), "query_ids": pa.array([table.column("vec_id").to_numpy().tobytes()], pa.binary()),
                "query_vecs": pa.array([dense(table.column("vec"), width).tobytes()], pa.binary()),
            })
            name += 1

    asked = vectors.where(F.pmod("vec_id", F.lit(every)) == 0)
    n_batches = max(1, -(-asked.count() // query_rows))
    queries = written(asked.repartition(n_batches, "vec_id").mapInArrow(gather, "batch long, query_ids binary, query_vecs binary"), "queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                x = np.frombuffer(row["vecs"], np.float64).reshape(-1, width)
                lifted = _lift(x * scale, 1.0)
                edges = np.frombuffer(row["edges"], np.int32).reshape(len(x) + 1, -1).astype(np.int64)
                entry, ids, many = (np.frombuffer(row[c], np.int64) for c in ("entry", "ids", "many"))
                first = np.cumsum(many) - many
                all_ids = np.frombuffer(row["query_ids"], np.int64)
                all_vecs = np.frombuffer(row["query_vecs"], np.float64).reshape(-1, width)
                for a in range(0, len(all_ids), 512):
                    q_ids, q = all_ids[a : a + 512], all_vecs[a : a + 512]
                    unit = q / np.maximum(np.sqrt((q**2).sum(1)), 1e-300)[:, None]
                    flat = np.concatenate([unit, np.zeros((len(q), 1))], 1).astype(np.float32)
                    near, _ = beam_search(lifted, edges, entry, flat, min(beam, len(x)))
                    qi, place = np.nonzero(near >= 0)
                    node = near[qi, place]
                    score = np.einsum("ij,ij->i", q[qi], x[node])
                    # Every copy of a node, without the query itself.
                    reps = many[node]
                    v = ids[np.repeat(first[node] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))]
                    qi, score = np.repeat(qi, reps), np.repeat(score, reps)
                    other = v != q_ids[qi]
                    qi, v, score = qi[other], v[other], score[other]
                    keep = best(qi, v, score, k)
                    yield pa.record_batch({"query_id": pa.array(q_ids[qi[keep]]), "vec_id": pa.array(v[keep]), "score": pa.array(score[keep])})

    pairs = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(index, "shard")
    spread = pairs.repartition(shards * n_batches, "shard", "batch")
    found = spread.drop("shard", "batch").mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7(spark, sf_dir: str) -> DataFrame:
    return graph_neighbours(clean_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
