"""Exact Hamming neighbours by multi-index hashing and by blocks, and the recall of the parity index.

A 64-bit code is cut into four parts of 16 bits. If two codes differ in at most ``4 s + 3``
bits, they differ in at most ``s`` bits in one of the parts (pigeonhole). So a round up to ``s`` meets
all pairs whose nearest part differs in ``s`` bits at most; then a query is done once ``k`` of its
neighbours lie within ``4 s + 3`` bits, and only the other queries go on to the next round.
Every pair is counted in one round and under one part only.

Which part values are near is found between distinct values (65,536 at most for each part), not between
codes. Pairs never leave the join: they are counted per query and distance, at most 65 numbers.
Codes are distinct on both sides, so a code held by half of all rows is one row. Where many distinct
codes share a part value, codes and queries of that value are dealt to cells of at most ``CELL`` by ``CELL``
rows.

The number of pairs of a round is known from the sizes of the part values before it is run. Once the rounds name so
many pairs that looking at them in blocks costs less, the open queries are compared with all codes in blocks: both
sides are arrays of codes, so a pair is an XOR and a bit count, and is counted only if it is near enough. How near that is
comes from a share of the codes, in growing shares: the k-th nearest code of a share is no nearer than the k-th of all.
Within a block the same parts keep far pairs apart, each part with the reach that makes all of them cheapest.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowsift.operators.lsh import LshModel, mate_distances
from flowsift.sources.results import work_folder

if TYPE_CHECKING:
    import pyarrow as pa

PARTS = 4
WIDTH = 16
# The bits in which a round's nearest part may differ, from and to.
ROUNDS = [(0, 0), (1, 1), (2, 2), (3, 3), (4, 5), (6, 8), (9, 16)]
# Rows of either side in one cell of a part value's join.
CELL = 4096
# Cells of shared part values that may be broadcast (a part value and two numbers).
BROADCAST_CELLS = 1_000_000
# A round is run if it names less than this share of the pairs: a joined pair costs a hundred pairs in blocks, and
# a round that settles few queries should not cost more than a tenth of the comparison.
ROUND_SHARE = 0.001
# The least share of the codes that open queries are compared with, and how much larger the next ones are.
FIRST_SHARE, SHARE_STEP = 256, 6
# Queries and codes in a block, and in a task; the fewest queries in a block that is made smaller to have tasks for all cores.
TASK_QUERIES, TASK_CODES = (262_144, 262_144), (1_048_576, 1_048_576)
LEAST_QUERIES, TASKS_PER_CORE = 16_384, 3
# Queries and codes that are compared at once.
TILE = (16, 4_096)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _part(code: Column, p: int) -> Column:
    return F.shiftrightunsigned(code, WIDTH * p).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("bigint")).cast("int")


def _parts(codes: DataFrame, name: str) -> DataFrame:
    """A row per code and part: embedding, p, and the part's value."""
    values = F.array(*[_part(F.col("embedding"), p) for p in range(PARTS)])
    return codes.select("embedding", F.posexplode(values).alias("p", name))


def _near_values(asked: DataFrame, known: DataFrame, low: int, high: int) -> DataFrame:
    """p, asked, known: pairs of distinct part values that differ in ``low`` to ``high`` bits."""
    asked, known = asked.select("p", "asked").distinct(), known.select("p", "known").distinct()
    if high < 4:
        masks = [sum(1 << b for b in bits) for r in range(low, high + 1) for bits in combinations(range(WIDTH), r)]
        mask = F.explode(F.from_json(F.lit(json.dumps(masks)), "array<int>"))  # one folded literal
        near = asked.select("p", "asked", mask.alias("mask")).select("p", "asked", F.col("asked").bitwiseXOR(F.col("mask")).alias("known"))
        return near.join(known, ["p", "known"], "left_semi")
    # Masks of more bits outnumber the values there are: four rows with at most 65,536 numbers each.
    lists = F.broadcast(known.groupBy("p").agg(F.collect_list("known").alias("list")))

    def close(x: Column) -> Column:
        return F.bit_count(F.col("asked").bitwiseXOR(x)).between(low, high)

    return asked.join(lists, "p").select("p", "asked", F.explode(F.filter("list", close)).alias("known"))


def _dealt(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the cell in which they meet; values with few rows have one cell."""
    on = ["p", "known"]
    sizes = left.groupBy(*on).agg(F.count("*").alias("queries")).join(right.groupBy(*on).agg(F.count("*").alias("codes")), on)
    cells = sizes.select(*on, F.ceil(F.col("queries") / CELL).cast("int").alias("rows"), F.ceil(F.col("codes") / CELL).cast("int").alias("columns"))
    cells = _stored(cells.where("rows > 1 or columns > 1"), "hamming-cells")
    n = cells.count()
    if not n:
        return left, right, on
    if n <= BROADCAST_CELLS:
        cells = F.broadcast(cells)

    def deal(side: DataFrame, own: str, other: str) -> DataFrame:
        size, copies = F.coalesce(own, F.lit(1)), F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)
        out = side.join(cells, on, "left").withColumn("own", F.pmod(F.xxhash64("embedding"), size).cast("int"))
        out = out.select(*side.columns, "own", F.explode(copies).alias("other"))
        row, column = ("own", "other") if own == "rows" else ("other", "own")
        return out.select(*side.columns, F.col(row).alias("row"), F.col(column).alias("column"))

    return deal(left, "rows", "columns"), deal(right, "columns", "rows"), [*on, "row", "column"]


def _round(queries: DataFrame, index: DataFrame, low: int, high: int, few: bool) -> DataFrame:
    """query, d, n: the pairs whose nearest parts differ in ``low`` to ``high`` bits, counted by distance.

    few: neither side has more rows than a cell.
    """
    asked, known = _parts(queries, "asked"), _parts(index, "known")
    left = asked.join(_near_values(asked, known, low, high), ["p", "asked"]).select("embedding", "p", "known")
    left, known, on = (left, known, ["p", "known"]) if few else _dealt(left, known)
    met = left.withColumnRenamed("embedding", "query").join(known.withColumnRenamed("embedding", "code"), on)
    crossed = F.col("query").bitwiseXOR(F.col("code"))
    bits = [F.bit_count(_part(crossed, p)) for p in range(PARTS)]
    least, first = F.least(*bits), F.lit(PARTS - 1)
    for p in reversed(range(PARTS - 1)):
        first = F.when(bits[p] == least, p).otherwise(first)
    once = (least >= low) & (first == F.col("p"))  # under the first of its nearest parts
    return met.where(once).groupBy("query", F.bit_count(crossed).alias("d")).agg(F.count("*").alias("n"))


def _round_pairs(queries: DataFrame, index: DataFrame, low: int, high: int) -> int:
    """How many pairs a round's join makes, from the sizes of the part values."""
    asked, known = _parts(queries, "asked"), _parts(index, "known")
    near = _near_values(asked, known, low, high)
    asked, known = asked.groupBy("p", "asked").agg(F.count("*").alias("queries")), known.groupBy("p", "known").agg(F.count("*").alias("codes"))
    pairs = near.join(asked, ["p", "asked"]).join(known, ["p", "known"])
    return pairs.agg(F.sum(F.col("queries").cast("double") * F.col("codes"))).first()[0] or 0


def _blocks(rows: DataFrame, entry: Column, n: int, sizes: tuple[int, int], name: str) -> DataFrame:
    """The ``n`` rows as arrays of about ``sizes[0]`` entries, in partitions of about ``sizes[1]`` rows."""
    size, in_task = sizes
    block = F.pmod(F.xxhash64("embedding", F.lit(name)), F.lit(-(-n // size)))
    parts = -(-n // in_task)
    blocks = rows.groupBy(block.alias("block")).agg(F.collect_list(entry).alias(name))
    return blocks.repartitionById(parts, F.pmod("block", F.lit(parts)).cast("int")).select(name)


def _compare(rows: int, columns: int, parts: int = PARTS, width: int = WIDTH):
    """Counts of a block's near pairs, compared in tiles of ``rows`` by ``columns``; refers to nothing that workers lack.

    A pair within a query's bound differs in at most ``t`` bits in one part, if the ``t + 1`` of all parts add up
    to more than the bound (pigeonhole). So a query meets only the codes whose value of a part is that near, and the ``t`` are
    chosen for the block: what each choice names is known from how often the values occur. ``t`` may be all
    bits of a part, then the block's codes are all looked at.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from math import comb

        import numpy as np
        import pyarrow as pa

        # Nanoseconds of a compared pair, a group of queries, a near value and a code listed for a group.
        PAIR, GROUP, VALUE, LISTED = 1.5, 30_000, 60, 4
        FLUSH = 1 << 22

        def walsh(v):
            h = 1
            while h < len(v):
                v = v.reshape(-1, 2, h)
                v = np.stack([v[:, 0] + v[:, 1], v[:, 0] - v[:, 1]], 1).ravel()
                h *= 2
            return v

        def values(codes, p, bits):
            return (codes.view(np.uint64) >> np.uint64(width * (p + 1) - bits)).astype(np.int64) & ((1 << bits) - 1)

        def plan(queries, codes, bounds, bits):
            """Cost of the block, and for each bound the bits in which every part may differ (-1: not looked at)."""
            weight = np.bitwise_count(np.arange(1 << bits, dtype=np.uint32))
            near_values = np.cumsum([comb(bits, t) for t in range(bits + 1)])
            best, way = [0.0] + [np.inf] * 65, [[] for _ in range(66)]
            for p in range(parts):
                asked = np.bincount(values(queries, p, bits), minlength=1 << bits).astype(float)
                known = np.bincount(values(codes, p, bits), minlength=1 << bits).astype(float)
                pairs = walsh(walsh(asked) * walsh(known)) / len(asked)
                pairs = np.cumsum(np.bincount(weight, weights=pairs, minlength=bits + 1))
                groups = np.count_nonzero(asked)
                cost = pairs * (PAIR + LISTED * groups / len(queries)) + groups * (GROUP + VALUE * near_values)
                cost[bits] = PAIR * len(queries) * len(codes)
                after, steps = [np.inf] * 66, [None] * 66
                for have in range(66):
                    for t in range(-1, bits + 1):
                        to = 65 if t == bits else min(65, have + t + 1)
                        if (c := best[have] + (cost[t] if t >= 0 else 0.0)) < after[to]:
                            after[to], steps[to] = c, [*way[have], t]
                best, way = after, steps
            chosen, total = {}, 0.0
            for bound, n in zip(*np.unique(bounds, return_counts=True)):
                at = min(range(min(int(bound), 64) + 1, 66), key=best.__getitem__)
                chosen[int(bound)] = way[at]
                total += best[at] * n / len(queries)
            return total, chosen

        def search(queries, bounds, codes):
            """Query, distance and number of codes, for the distances within the bound."""
            options = [bits for bits in (8, 10, 12, 13, 14, 15, 16) if bits == 8 or 1 << bits <= len(codes)]
            bits, (_, chosen) = min(((b, plan(queries, codes, bounds, b)) for b in options), key=lambda x: x[1][0])
            limits = np.full((65, parts), -1)
            for bound, ways in chosen.items():
                limits[bound] = ways
            weight = np.bitwise_count(np.arange(1 << bits, dtype=np.uint32))
            fields = [np.int64(np.uint64(((1 << bits) - 1) << (width * (p + 1) - bits)).view(np.int64)) for p in range(parts)]
            counts, found, waiting = np.zeros(65 * len(queries), np.int32), [], 0
            buffers = [np.empty(rows * columns, kind) for kind in (np.int64, np.uint8, bool)]
            every = np.arange(len(codes))

            def settle():
                nonlocal counts, found, waiting
                if found:
                    counts += np.bincount(np.concatenate(found), minlength=len(counts)).astype(np.int32)
                found, waiting = [], 0

            for p in range(parts):
                allowed = limits[bounds, p]
                here = np.flatnonzero(allowed >= 0)
                if not len(here):
                    continue
                known = values(codes, p, bits)
                order = np.argsort(known, kind="stable")
                known, ends = codes[order], np.concatenate([[0], np.cumsum(np.bincount(known, minlength=1 << bits))])
                value = np.where(allowed[here] == bits, 0, values(queries[here], p, bits))
                here = here[np.lexsort((value, allowed[here]))]
                allowed, value = allowed[here], np.where(allowed[here] == bits, 0, values(queries[here], p, bits))
                cuts = np.flatnonzero((np.diff(allowed) != 0) | (np.diff(value) != 0)) + 1
                masks, last = None, -1
                for start, end in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(here)]]).tolist()):
                    t = allowed[start]
                    if t != last:
                        masks, last = np.flatnonzero(weight <= t), t
                    near = known
                    if t < bits:
                        at = masks ^ value[start]
                        first = ends[at]
                        length = ends[at + 1] - first
                        total = np.cumsum(length)
                        near = known[np.repeat(first - total + length, length) + every[: total[-1]]]
                    for q in range(start, end, rows):
                        who = here[q : min(q + rows, end)]
                        left, limit = queries[who][:, None], bounds[who][:, None]
                        for c in range(0, len(near), columns):
                            right = near[None, c : c + columns]
                            shape, n = (len(who), right.shape[1]), len(who) * right.shape[1]
                            crossed, d, hit = (b[:n].reshape(shape) for b in buffers)
                            np.bitwise_xor(left, right, out=crossed)
                            np.bitwise_count(crossed.view(np.uint64), out=d)
                            np.less_equal(d, limit, out=hit)
                            hits = np.flatnonzero(hit)
                            if not len(hits):
                                continue
                            asked, far = who[hits // shape[1]], d.ravel()[hits]
                            if p:  # counted under the first part that is near enough
                                x, new = crossed.ravel()[hits], np.ones(len(hits), bool)
                                for before in range(p):
                                    new &= np.bitwise_count((x & fields[before]).view(np.uint64)) > limits[bounds[asked], before]
                                asked, far = asked[new], far[new]
                            found.append(asked * 65 + far)
                            waiting += len(asked)
                            if waiting > FLUSH:
                                settle()
            settle()
            at = np.flatnonzero(counts)
            return queries[at // 65], (at % 65).astype(np.int32), counts[at].astype(np.int64)

        for batch in batches:
            asked, bounds, known = (batch.column(name) for name in ("query", "bound", "known"))
            for i in range(batch.num_rows):
                queries, codes = asked[i].values.to_numpy(), known[i].values.to_numpy()
                out = search(queries, bounds[i].values.to_numpy().astype(np.uint8), codes)
                yield pa.RecordBatch.from_arrays([pa.array(column) for column in out], ["query", "d", "n"])

    return compare


def _near_pairs(queries: DataFrame, index: DataFrame, open_queries: int, size: int) -> DataFrame:
    """query, d, n: the pairs within ``bound`` of each query, counted by distance.

    Both sides are compared block by block. Blocks are large, since more codes share a value then, but
    there are enough of them for all cores.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    fewest = min(-(-open_queries // LEAST_QUERIES), -(-TASKS_PER_CORE * cores // -(-size // TASK_CODES[1])))
    sizes = tuple(min(n, -(-open_queries // fewest)) for n in TASK_QUERIES)
    asked = _blocks(queries, F.struct("embedding", "bound"), open_queries, sizes, "asked")
    known = _blocks(index, F.col("embedding"), size, TASK_CODES, "known")
    asked = asked.select(F.col("asked.embedding").alias("query"), F.col("asked.bound").alias("bound"))
    met = asked.hint("shuffle_replicate_nl").crossJoin(known)
    return met.mapInArrow(_compare(*TILE), "query bigint, d int, n bigint").groupBy("query", "d").agg(F.sum("n").alias("n"))


def _compare_all(queries: DataFrame, index: DataFrame, wanted: int, open_queries: int, size: int) -> DataFrame:
    """``(query, d, n)`` of all codes up to the ``wanted``-th nearest of each query, for ``size`` codes.

    Every share gives the distance that the next one need not exceed, so few pairs are looked at and counted.
    """
    shares, bounded = [size // SHARE_STEP], queries.withColumn("bound", F.lit(64))
    while shares[0] >= FIRST_SHARE * SHARE_STEP:
        shares.insert(0, shares[0] // SHARE_STEP)
    for share in shares:
        if share < FIRST_SHARE:
            continue
        part = index.where(F.pmod(F.xxhash64("embedding"), F.lit(-(-size // share))) == 0)
        before = F.sum("n").over(Window.partitionBy("query").orderBy("d"))  # at most 65 rows
        reached = _near_pairs(bounded, part, open_queries, share).withColumn("upto", before).where(F.col("upto") >= wanted)
        bound = reached.groupBy(F.col("query").alias("embedding")).agg(F.min("d").alias("reached"))
        bounded = _stored(
            bounded.join(bound, "embedding", "left").select("embedding", F.coalesce("reached", "bound").alias("bound")), "hamming-bounds"
        )
    return _stored(_near_pairs(bounded, index, open_queries, size), "hamming-near")


def neighbour_histogram(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """``(query, d, n)``: how many distinct index codes lie at each distance, complete up to the k-th nearest.

    ``queries`` and ``index`` have a column ``embedding``. Without index codes there are no rows.
    """
    index = _stored(index.select("embedding").where("embedding is not null").distinct(), "hamming-index")
    left = _stored(queries.select("embedding").where("embedding is not null").distinct(), "hamming-queries")
    size, open_queries = index.count(), left.count()
    wanted = min(k, size)
    done: list[DataFrame] = []
    counts = None
    for low, high in ROUNDS:
        if not wanted or not open_queries or _round_pairs(left, index, low, high) > ROUND_SHARE * open_queries * size:
            break
        found = _round(left, index, low, high, size <= CELL and open_queries <= CELL)
        if counts is not None:
            found = counts.unionByName(found).groupBy("query", "d").agg(F.sum("n").alias("n"))
        reach = PARTS * high + PARTS - 1
        near = F.sum(F.when(F.col("d") <= reach, F.col("n"))).over(Window.partitionBy("query"))  # at most 65 rows
        state = _stored(found.withColumn("done", F.coalesce(near >= wanted, F.lit(False))), "hamming-counts")
        done.append(state.where(F.col("done") & (F.col("d") <= reach)).drop("done"))
        counts = state.where("not done").drop("done")
        full = state.where("done").select("query").distinct()
        open_queries -= full.count()
        left = left.join(full, left["embedding"] == full["query"], "left_anti")
    if wanted and open_queries:
        done.append(_compare_all(_stored(left, "hamming-open"), index, wanted, open_queries, size))
    if not done:
        return queries.sparkSession.createDataFrame([], "query bigint, d int, n bigint")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _taken(hist: DataFrame, k: int) -> DataFrame:
    """Adds ``take``: how many of the k nearest lie at each distance; a window holds at most 65 rows."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = hist.withColumn("before", before).where(F.col("before") < k)
    return taken.withColumn("take", F.least(F.col("n"), F.lit(k) - F.col("before"))).drop("before")


def exact_knn(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """embedding, k, min_distance, kth_distance, avg_distance of each distinct query's k nearest distinct codes."""
    taken = _taken(neighbour_histogram(queries, index, k), k)
    return taken.groupBy(F.col("query").alias("embedding")).agg(
        F.sum("take").alias("k"), F.min("d").alias("min_distance"), F.max("d").alias("kth_distance"),
        (F.sum(F.col("take") * F.col("d")).cast("double") / F.sum("take")).alias("avg_distance"),
    )


def index_recall(model: LshModel, queries: DataFrame, k: int) -> DataFrame:
    """By distance: the true k nearest codes of all queries, and how many of them are bucket-mates in the index.

    ``queries``: run, embedding and packed words (``model.hash``) of one run.
    """
    true = _taken(neighbour_histogram(queries, model.codes, k), k)
    # Mates beyond their own k-th nearest cannot be among the k nearest of all codes.
    mates = mate_distances(model, queries, k).withColumnRenamed("n", "mates")
    both = true.join(mates, ["query", "d"], "left")
    found = F.least(F.col("take"), F.coalesce("mates", F.lit(0)))
    return both.groupBy(F.col("d").alias("distance")).agg(F.sum("take").alias("true_neighbours"), F.sum(found).alias("found")).withColumn(
        "recall", F.col("found").cast("double") / F.col("true_neighbours")
    )
