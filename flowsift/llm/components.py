"""Connected components of a graph of ids, by alternating large and small stars.

Every round joins the edges with each node's smallest neighbour. Smallest neighbours
are summed up map-side and written first, so both sides of a join are plain shuffles that Spark
can split where a hub has very many edges. The number of rounds grows with the
logarithm of the longest chain. Nothing but a row count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.scratch import written


def _smallest(edges: DataFrame) -> DataFrame:
    return written(edges.groupBy("a").agg(F.min("b").alias("m")), "stars").withColumnRenamed("a", "__a")


def connected(edges: DataFrame) -> DataFrame:
    """edges: a, b (ids). Returns node, root for all nodes but roots; root: smallest id of the component."""
    edges = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _smallest(both)
        large = both.where("b > a").join(low, F.col("a") == F.col("__a")).select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = written(large.distinct(), "edges")
        low = _smallest(large)
        star = large.join(low, F.col("a") == F.col("__a")).select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        edges = written(star.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_000_007).alias("s")).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
