"""Local outlier factor by an exact distributed nearest-neighbour search.

Points are put in the cells of a space partition (median cuts of a seeded
sample). Each point first finds its k nearest inside its own cell. That k-th
distance bounds the search: only cells whose box comes nearer can hold a closer
point, and the point is sent to those alone. No cell is compared with all
others, and the answer is exact.

Equal points are one row with a multiplicity. A cell that is larger than one
task should hold is cut into blocks; blocks only add partial lists of k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.functions.held import hold
from flowsift.operators.quantiles import exact_quantiles
from flowsift.operators.sampling import sample_n
from flowsift.schema import LOF_MODEL

CELL_POINTS = 2_000  # points aimed at per cell
BLOCK_POINTS = 8_192  # points of a cell that one task compares at a time
SAMPLE_POINTS = 100_000  # points from which the cuts are computed


class SpacePartition:
    """Binary tree of axis cuts; leaves are cells."""

    def __init__(self, dims: int):
        self.dims = dims
        self.axis, self.cut, self.left, self.right, self.cell = [], [], [], [], []
        self.cells = 0

    @classmethod
    def build(cls, sample: np.ndarray, leaf: int) -> "SpacePartition":
        tree = cls(sample.shape[1])
        tree._grow(sample, leaf)
        return tree

    def _grow(self, points: np.ndarray, leaf: int) -> int:
        node = len(self.axis)
        for column in (self.axis, self.cut, self.left, self.right, self.cell):
            column.append(-1)
        spread = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(self.dims)
        axis = int(np.argmax(spread))
        cut = float(np.median(points[:, axis])) if len(points) else 0.0
        low = points[:, axis] <= cut if len(points) else np.zeros(0, dtype=bool)
        if len(points) <= leaf or spread[axis] == 0 or low.all():
            self.cell[node] = self.cells
            self.cells += 1
            return node
        self.axis[node], self.cut[node] = axis, cut
        self.left[node] = self._grow(points[low], leaf)
        self.right[node] = self._grow(points[~low], leaf)
        return node

    def locate(self, points: np.ndarray) -> np.ndarray:
        """Cell of each point."""
        out = np.zeros(len(points), dtype=np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if self.cell[node] >= 0:
                out[rows] = self.cell[node]
                continue
            low = points[rows, self.axis[node]] <= self.cut[node]
            todo += [(self.left[node], rows[low]), (self.right[node], rows[~low])]
        return out

    def reach(self, points: np.ndarray, radius: np.ndarray):
        """``(row, cell)`` for all cells within ``radius`` of each point.

        Walks down the tree with the squared distance to the half-spaces cut off
        so far, per axis; the sum bounds the distance to the box from below.
        """
        found_rows, found_cells = [], []
        todo = [(0, np.arange(len(points)), np.zeros((len(points), self.dims)))]
        limit = radius * (1 + 1e-12) + 1e-300
        while todo:
            node, rows, gaps = todo.pop()
            if not len(rows):
                continue
            if self.cell[node] >= 0:
                found_rows.append(rows)
                found_cells.append(np.full(len(rows), self.cell[node], dtype=np.int32))
                continue
            axis = self.axis[node]
            offset = points[rows, axis] - self.cut[node]
            for child, gap in ((self.left[node], np.maximum(offset, 0)), (self.right[node], np.maximum(-offset, 0))):
                wider = gaps.copy()
                wider[:, axis] = np.maximum(wider[:, axis], gap)
                near = np.sqrt((wider**2).sum(axis=1)) <= limit[rows]
                todo.append((child, rows[near], wider[near]))
        if not found_rows:
            return np.zeros(0, dtype=int), np.zeros(0, dtype=np.int32)
        return np.concatenate(found_rows), np.concatenate(found_cells)


def _nearest_lists(queries, points, point_ids, weights, k):
    """For each query the nearest points (other than itself by id) that cover k copies."""
    lists = []
    for start in range(0, len(queries[0]), 256):
        ids, block, own = (q[start:start + 256] for q in queries)
        distance = np.sqrt(((block[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
        weight = np.broadcast_to(weights, distance.shape).copy()
        same = ids[:, None] == point_ids[None, :]
        weight[same] -= 1  # a point is not its own neighbour, its copies are
        distance[same & (weight <= 0)] = np.inf
        keep = min(k, len(points))
        best = np.argpartition(distance, keep - 1, axis=1)[:, :keep] if keep < len(points) else np.tile(np.arange(len(points)), (len(block), 1))
        for r in range(len(block)):
            chosen = best[r]
            chosen = chosen[np.isfinite(distance[r, chosen])]
            order = chosen[np.lexsort((point_ids[chosen], distance[r, chosen]))]
            reached = np.cumsum(weight[r, order])
            order = order[: int(np.searchsorted(reached, k)) + 1]
            lists.append((int(ids[r]), point_ids[order].tolist(), distance[r, order].tolist(), weight[r, order].tolist()))
    return lists


_LIST_SCHEMA = "id bigint, nb array<bigint>, d array<double>, w array<bigint>"


def _search(k: int):
    def search(key, queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(points):
            return pd.DataFrame([], columns=["id", "nb", "d", "w"])
        q = (queries["id"].to_numpy(), np.array(queries["features"].tolist()), None)
        rows = _nearest_lists((q[0], q[1], q[0]), np.array(points["features"].tolist()), points["id"].to_numpy(),
                              points["copies"].to_numpy(dtype=np.int64), k)
        return pd.DataFrame(rows, columns=["id", "nb", "d", "w"])

    return search


def _merge(lists: DataFrame, k: int) -> DataFrame:
    """Combine partial lists of a point into its nearest list covering k copies."""
    entries = lists.select("id", F.explode(F.arrays_zip("d", "nb", "w")).alias("e"))
    merged = entries.groupBy("id").agg(F.array_sort(F.collect_list("e")).alias("es"))

    def add(acc, e):
        take = F.least(e["w"], F.lit(k).cast("bigint") - acc["have"])
        row = F.struct(e["nb"].alias("nb"), e["d"].alias("d"), take.alias("w"))
        return F.struct(
            (acc["have"] + take).alias("have"),
            F.when(take > 0, F.concat(acc["rows"], F.array(row))).otherwise(acc["rows"]).alias("rows"),
        )

    empty = F.expr("struct(0L as have, cast(array() as array<struct<nb:bigint,d:double,w:bigint>>) as rows)")
    return merged.select("id", F.aggregate("es", empty, add, lambda a: a["rows"]).alias("rows"))


def nearest_neighbours(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Exact k nearest neighbours of each distinct point.

    ``points`` is ``(id, features, copies)`` with distinct features. Result:
    ``(id, rows)`` where rows are ``(nb, d, w)`` ordered by distance and the
    weights (copies) add up to k where that many points exist.
    """
    sample = sample_n(points.select("id", "features"), SAMPLE_POINTS, seed).toPandas()
    total = points.count()
    values = np.array(sample["features"].tolist(), dtype=float)
    leaf = max(2 * k, int(CELL_POINTS * len(values) / max(total, 1)))
    tree = SpacePartition.build(values, leaf)

    def place(batches):
        for batch in batches:
            if len(batch):
                batch["cell"] = tree.locate(np.array(batch["features"].tolist(), dtype=float))
                yield batch

    placed = points.mapInPandas(place, "id bigint, features array<double>, copies bigint, cell int").persist()
    # Blocks of a cell and groups of its queries keep each task's matrix small.
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_POINTS)
    parts = sizes.select("cell", F.ceil(F.col("n") / BLOCK_POINTS).cast("int").alias("parts"))

    def search(queries: DataFrame) -> DataFrame:
        """Partial lists of queries ``(id, features, cell)`` in their cells."""
        split = F.coalesce(F.col("parts"), F.lit(1))
        sides = []
        for side in (queries, placed):
            sides.append(side.join(parts, "cell", "left").withColumn("parts", split))
        mine = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        left = sides[0].withColumn("group", mine).withColumn("block", every)
        right = sides[1].withColumn("block", mine).withColumn("group", every)
        keys = ["cell", "block", "group"]
        left = left.toDF(*left.columns)  # fresh column identities: both sides come from one table
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search(k), _LIST_SCHEMA)

    own = search(placed.select("id", "features", "cell")).persist()
    inside = _merge(own, k)
    covered = F.aggregate("rows", F.lit(0).cast("bigint"), lambda a, r: a + r["w"])
    bound = F.when(covered >= k, F.element_at("rows", -1)["d"]).otherwise(F.lit(float("inf")))
    bounded = placed.select("id", "features", "cell").join(inside.select("id", bound.alias("bound")), "id", "left")
    bounded = bounded.withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

    def spread(batches):
        for batch in batches:
            if not len(batch):
                continue
            rows, cells = tree.reach(np.array(batch["features"].tolist(), dtype=float), batch["bound"].to_numpy(dtype=float))
            out = batch.iloc[rows][["id", "features", "cell"]].copy()
            out["target"] = cells
            out = out[out["target"] != out["cell"]]
            yield pd.DataFrame({"id": out["id"], "features": out["features"], "cell": out["target"]})

    others = search(bounded.mapInPandas(spread, "id bigint, features array<double>, cell int"))
    return _merge(own.unionByName(others), k)


def local_outlier_factor(
    vectors: DataFrame, k: int = 20, contamination: float = 0.1, ident: str = "id"
) -> DataFrame:
    """``(id, model, is_anomaly, score)``: LOF of a batch, fitted on the batch itself.

    The score is the factor; the share ``contamination`` with the largest
    factors is flagged.
    """
    rows = vectors.select(F.col(ident).alias("row_id"), "features")
    points = rows.groupBy("features").agg(F.min("row_id").alias("id"), F.count("*").alias("copies")).select("id", "features", "copies")
    points = hold(points)
    near = hold(nearest_neighbours(points, k))
    k_distance = near.select("id", F.element_at("rows", -1)["d"].alias("k_distance"))
    pairs = near.select("id", F.explode("rows").alias("r")).select("id", "r.nb", "r.d", "r.w")
    reach = pairs.join(k_distance.withColumnRenamed("id", "nb"), "nb").select(
        "id", "nb", "w", F.greatest("k_distance", "d").alias("reach")
    )
    density = reach.groupBy("id").agg((F.lit(1.0) / (F.sum(F.col("reach") * F.col("w")) / F.sum("w") + 1e-10)).alias("lrd"))
    around = reach.select("id", "nb", "w").join(density.withColumnRenamed("id", "nb"), "nb")
    factor = hold(
        around.groupBy("id").agg((F.sum(F.col("lrd") * F.col("w")) / F.sum("w")).alias("mean_lrd"))
        .join(density, "id").select("id", (F.col("mean_lrd") / F.col("lrd")).alias("factor"))
    )
    scored = rows.join(points.select("id", "features"), "features").join(factor, "id").select(
        F.col("row_id").alias(ident), "factor"
    )
    limit = exact_quantiles(scored.select((-F.col("factor")).alias("raw")), "raw", [contamination]).first()
    cut = limit["q0"] if limit else 0.0
    return scored.select(ident, F.lit(LOF_MODEL).alias("model"), (-F.col("factor") < cut).alias("is_anomaly"), F.col("factor").alias("score"))
