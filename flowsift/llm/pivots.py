"""Exact top-k search by inner product with a pivot-distance index.

1. Vectors get one more component, root(M - |x|^2), with M the largest squared length;
   then |q - x|^2 = |q|^2 + M - 2qx for a query with 0 there, so the best products are the nearest vectors.
2. Every vector is keyed by its nearest pivot and the distance to it, and sorted so.
   Runs of ``block_rows`` vectors of one pivot are the blocks of the index: annuli
   with a least and a greatest distance. Pivots are centres of a sample of ``sample``
   vectors; all vectors are indexed.
3. Queries with near keys are batches. A batch first visits the ``first`` annuli that
   may hold the nearest vectors and gets a k-th best score for every query. In the
   second round it expands further annuli in order of their least possible distance (triangle inequality),
   and stops, for each query and for the batch, where none can hold a better score.

Scores are exact in integers; bounds have a margin, so no result is lost by rounding.
Blocks, not rows, are dealt to batches, and what a task holds is bounded by ``part_blocks`` blocks.

Vectors with a component beyond 2^26 are not in the index: their annuli would have no exact
distances. They are compared in blocks, in Python's integers, with the stated set of queries,
and the queries among them with all vectors; what is found joins the rest before the last rank.

Defined results: vectors with null, NaN or infinite components, or a null id, take no part;
so do components that are infinite once scaled; scores beyond a long count as its ends; shorter vectors count as
padded with zeros; rows that share an id are one vector (that which sorts last); a query
with fewer candidates has fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsift.llm.neardup import by_key
from flowsift.llm.scratch import ship, written
from flowsift.llm.vectors import best, chunks, clean_vectors, dense

LIMIT = 1 << 26
RESULT = "query_id long, vec_id long, score long"


def integer_vectors(table: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, vec: whole numbers as double, of any size."""
    # A double from 2^53 on is whole, and floor's long would end at 2^63.
    scaled = lambda x: x * float(scale)
    whole = clean_vectors(table).withColumn("vec", F.transform("vec", lambda x: F.when(F.abs(scaled(x)) < 2.0**53, F.floor(scaled(x)).cast("double")).otherwise(scaled(x))))
    return whole.where(F.forall("vec", lambda x: F.abs(x) < float("inf")))


def _compare(k: int, ends: tuple[int, int] = (-(2**63), 2**63 - 1)):
    """The k best candidates (kind 1) of every query (kind 0) of a pair of blocks, in Python's integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in by_key(batches, ["qb", "cb"]):
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                rows = [(r["kind"], r["vec_id"], [int(x) for x in r["vec"]]) for r in table.slice(a, b - a).to_pylist()]
                others = [(i, v) for kind, i, v in rows if kind]
                for kind, query, vec in rows:
                    if kind:
                        continue
                    scores = [(max(ends[0], min(ends[1], sum(x * y for x, y in zip(vec, v, strict=False)))), i) for i, v in others if i != query]
                    top = heapq.nsmallest(k, ((-s, i) for s, i in scores))
                    if top:
                        yield pa.record_batch({
                            "query_id": pa.array([query] * len(top), pa.int64()), "vec_id": pa.array([i for _, i in top], pa.int64()),
                            "score": pa.array([-s for s, _ in top], pa.int64()),
                        })

    return run


def _in_blocks(queries: DataFrame, others: DataFrame, k: int, rows: int = 512) -> DataFrame:
    """All queries against all others, blocks of about ``rows`` by hash, every pair of blocks a group of its own."""
    n_q, n_c = (max(1, -(-x.count() // rows)) for x in (queries, others))
    block = lambda n: F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", "vec", F.lit(0).alias("kind"), block(n_q).alias("qb")).withColumn("cb", every(n_c))
    right = others.select("vec_id", "vec", F.lit(1).alias("kind"), block(n_c).alias("cb")).withColumn("qb", every(n_q))
    dealt = left.unionByName(right).repartition("qb", "cb").sortWithinPartitions("qb", "cb", "kind")
    return dealt.mapInArrow(_compare(k), RESULT)


def _centres(sample: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """Some rounds of nearest-centre averaging from evenly drawn starts."""
    centres = np.unique(sample, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(n, len(centres))).astype(int)].astype(np.float64)
    for _ in range(rounds):
        near = ((sample**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * sample @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        n_of = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(n_of > 0, sums / np.maximum(n_of, 1), centres)
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0))


def _lift(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(longest - (x**2).sum(1), 0))[:, None]], 1)


def _visit(k: int, longest: float, pivots: np.ndarray, width: int):
    """Scores of a batch's queries in the blocks dealt to it, in order; kind 0: the queries, 1: a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in by_key(batches, ["batch", "part"]):
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                rows = table.slice(a, b - a).to_pylist()
                head = rows[0]
                assert head["kind"] == 0
                ids = np.frombuffer(head["ids"], np.int64)
                queries = np.frombuffer(head["vecs"], np.int32).astype(np.float64).reshape(-1, width)
                least = np.frombuffer(head["least"], np.float64).copy()
                lengths = (queries**2).sum(1)
                to_pivot = _distances(np.concatenate([queries, np.zeros((len(queries), 1))], 1), pivots)
                exact = np.abs(queries).max(initial=0) * LIMIT * width < 2**53
                q_all, v_all, s_all = (np.zeros(0, np.int64) for _ in range(3))
                for row in rows[1:]:
                    d = to_pivot[:, row["pivot"]]
                    nearest = np.maximum(np.maximum(d - row["hi"], row["lo"] - d), 0)
                    bound = (lengths + longest - nearest**2) / 2
                    open_ = np.flatnonzero(bound + 1e-6 * (lengths + longest) + 0.5 >= least)
                    if not len(open_):
                        continue
                    own = np.frombuffer(row["ids"], np.int64)
                    vecs = np.frombuffer(row["vecs"], np.int32).reshape(-1, width)
                    if exact or np.abs(vecs).max(initial=0) * np.abs(queries).max(initial=0) * width < 2**53:
                        scores = (queries[open_] @ vecs.T.astype(np.float64)).astype(np.int64)
                    else:
                        scores = queries[open_].astype(np.int64) @ vecs.T.astype(np.int64)
                    hit = (scores >= least[open_][:, None]) & (own != ids[open_][:, None])
                    q, v = np.nonzero(hit)
                    q_all, v_all = np.concatenate([q_all, open_[q]]), np.concatenate([v_all, own[v]])
                    s_all = np.concatenate([s_all, scores[q, v]])
                    keep = best(q_all, v_all, s_all, k)
                    q_all, v_all, s_all = q_all[keep], v_all[keep], s_all[keep]
                    full = np.bincount(q_all, minlength=len(ids)) == k
                    kth = np.full(len(ids), -np.inf)
                    last = np.flatnonzero(np.append(q_all[1:] != q_all[:-1], True)) if len(q_all) else np.zeros(0, np.int64)
                    kth[q_all[last]] = s_all[last]
                    least = np.where(full, np.maximum(least, kth), least)
                yield pa.record_batch({"query_id": pa.array(ids[q_all]), "vec_id": pa.array(v_all), "score": pa.array(s_all)})

    return run


def pivot_top_k(
    vectors: DataFrame, k: int = 20, every: int = 20, pivots: int = 64, sample: int = 4096, block_rows: int = 1024,
    batch_rows: int = 256, first: int = 4, part_blocks: int = 64,
) -> DataFrame:
    """vectors: vec_id, vec (whole numbers as double). Queries: ids divisible by ``every``. Returns query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ship(spark)
    everything = written(vectors, "integer-vectors")
    within = F.forall("vec", lambda x: F.abs(x) <= LIMIT)
    asks = F.pmod("vec_id", F.lit(every)) == 0
    vectors, large = everything.where(within), everything.where(~within)
    beyond = None
    if not large.isEmpty():
        beyond = _in_blocks(large.where(asks), everything, k).unionByName(_in_blocks(vectors.where(asks), large, k))

    def ranked_best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    squared = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    facts = vectors.agg(F.max(F.size("vec")).alias("width"), F.max(squared).alias("longest"), F.count("*").alias("n")).first()
    if not facts["n"]:
        return ranked_best(spark.createDataFrame([], RESULT) if beyond is None else beyond)
    width, longest = max(1, facts["width"]), float(facts["longest"])
    some = vectors.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(sample).select("vec").toArrow()
    centres = _centres(_lift(dense(some.column("vec"), width), longest), pivots)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense(batch.column("vec"), width)
            lifted = _lift(x, longest)
            d = _distances(lifted, centres)
            near = d.argmin(1)
            # As a difference, so that the distance is exact enough for the bounds.
            at = np.sqrt(((lifted - centres[near]) ** 2).sum(1))
            yield pa.record_batch({
                "pivot": pa.array(near.astype(np.int32)), "at": pa.array(at), "vec_id": batch.column("vec_id"),
                "vec": pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary()),
            })

    def gather(rows: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name = TaskContext.get().partitionId() << 32
            for table in chunks(batches, rows):
                pivot = table.column("pivot").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    part = table.slice(a, b - a)
                    ids = part.column("vec_id").to_numpy()
                    order = np.argsort(ids, kind="stable")
                    vecs = part.column("vec").to_pylist()
                    at = part.column("at").to_numpy()
                    yield pa.record_batch({
                        "block": pa.array([name]), "pivot": pa.array([int(pivot[a])], pa.int32()),
                        "lo": pa.array([float(at.min())]), "hi": pa.array([float(at.max())]),
                        "ids": pa.array([ids[order].tobytes()], pa.binary()), "vecs": pa.array([b"".join(vecs[i] for i in order)], pa.binary()),
                    })
                    name += 1

        return run

    def blocks_of(rows: DataFrame, n: int, name: str) -> DataFrame:
        keys = rows.mapInArrow(keyed, "pivot int, at double, vec_id long, vec binary")
        ordered = keys.repartitionByRange("pivot", "at", "vec_id").sortWithinPartitions("pivot", "at", "vec_id")
        return written(ordered.mapInArrow(gather(n), "block long, pivot int, lo double, hi double, ids binary, vecs binary"), name)

    blocks = blocks_of(vectors, block_rows, "annuli")
    batches = blocks_of(vectors.where(asks), batch_rows, "query-batches")

    def bounds(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each batch and pivot the least and greatest distance of its queries."""
        for batch in rows:
            for name, raw in zip(batch.column("block").to_pylist(), batch.column("vecs").to_pylist(), strict=True):
                q = np.frombuffer(raw, np.int32).astype(np.float64).reshape(-1, width)
                d = _distances(np.concatenate([q, np.zeros((len(q), 1))], 1), centres)
                n = len(centres)
                yield pa.record_batch({
                    "batch": pa.array(np.full(n, name)), "pivot": pa.array(np.arange(n, dtype=np.int32)),
                    "near": pa.array(d.min(0)), "far": pa.array(d.max(0)), "length": pa.array(np.full(n, (q**2).sum(1).max())),
                })

    to_pivots = batches.select("block", "vecs").mapInArrow(bounds, "batch long, pivot int, near double, far double, length double")
    low = F.greatest(F.col("near") - F.col("hi"), F.col("lo") - F.col("far"), F.lit(0.0))
    pairs = to_pivots.join(blocks.select("block", "pivot", "lo", "hi"), "pivot").select("batch", "block", low.alias("low"), "length")
    ranked = written(pairs.withColumn("rank", F.row_number().over(Window.partitionBy("batch").orderBy("low", "block"))), "visits")

    def search(visits: DataFrame, least: DataFrame) -> DataFrame:
        visits = visits.withColumn("part", F.floor(F.col("rank") / part_blocks).cast("int"))
        what = visits.join(blocks, "block").select("batch", "part", F.lit(1).alias("kind"), "rank", "pivot", "lo", "hi", "ids", "vecs", F.lit(None).cast("binary").alias("least"))
        heads = least.join(visits.select(F.col("batch").alias("b"), "part").distinct(), F.col("batch") == F.col("b")).select(
            "batch", "part", F.lit(0).alias("kind"), F.lit(0).alias("rank"), F.lit(0).alias("pivot"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), "ids", "vecs", "least"
        )
        dealt = what.unionByName(heads).repartition("batch", "part").sortWithinPartitions("batch", "part", "kind", "rank")
        return dealt.mapInArrow(_visit(k, longest, centres, width), RESULT)

    def no_bound(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            least = [np.full(len(x) // 8, -np.inf).tobytes() for x in batch.column("ids").to_pylist()]
            yield pa.record_batch({"batch": batch.column("block"), "ids": batch.column("ids"), "vecs": batch.column("vecs"), "least": pa.array(least, pa.binary())})

    head = "batch long, ids binary, vecs binary, least binary"
    start = batches.select("block", "ids", "vecs").mapInArrow(no_bound, head)
    found = written(search(ranked.where(F.col("rank") <= first), start), "first-found")
    kth = found.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k)

    def with_bound(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                known = {x["query_id"]: float(x["kth"]) for x in row["known"] or ()}
                ids = np.frombuffer(row["ids"], np.int64)
                least = np.array([known.get(i, -np.inf) for i in ids.tolist()])
                yield pa.record_batch({
                    "batch": pa.array([row["block"]]), "ids": pa.array([row["ids"]], pa.binary()), "vecs": pa.array([row["vecs"]], pa.binary()),
                    "least": pa.array([least.tobytes()], pa.binary()), "lowest": pa.array([float(least.min())]),
                })

    def names(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for name, raw in zip(batch.column("block").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(raw, np.int64)
                yield pa.record_batch({"batch": pa.array(np.full(len(ids), name)), "query_id": pa.array(ids)})

    home = batches.select("block", "ids").mapInArrow(names, "batch long, query_id long")
    known = home.join(kth, "query_id").groupBy("batch").agg(F.collect_list(F.struct("query_id", "kth")).alias("known"))
    heads = written(
        batches.select("block", "ids", "vecs").join(known, F.col("block") == F.col("batch"), "left").select("block", "ids", "vecs", "known")
        .mapInArrow(with_bound, head + ", lowest double"),
        "query-bounds",
    )
    best_left = (F.col("length") + longest - F.col("low") ** 2) / 2 + 1e-6 * (F.col("length") + longest) + 0.5
    further = ranked.where(F.col("rank") > first).join(heads.select(F.col("batch").alias("b"), "lowest"), F.col("batch") == F.col("b")).where(best_left >= F.col("lowest"))
    all_found = found.unionByName(search(further.select("batch", "block", "low", "rank"), heads.drop("lowest")))
    return ranked_best(all_found if beyond is None else all_found.unionByName(beyond))


def op2(spark, sf_dir: str) -> DataFrame:
    return pivot_top_k(integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


OP2_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
"""
