"""Seeded samples, label filters and the stratified test set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowsift.functions.held import hold
from flowsift.functions.numeric import seeded_key, uniform

# Up to this many rows a sample is one bounded top-n; beyond it the sample is
# cut by key ranges, so no task ever holds all of it.
TOP_N_LIMIT = 100_000


def with_label(flows: DataFrame, *labels: int) -> DataFrame:
    return flows.where(F.col("label").isin(*labels) if len(labels) > 1 else F.col("label") == labels[0])


def sample_n(df: DataFrame, n: int, seed: int, ident: str = "id") -> DataFrame:
    """``min(n, rows)`` rows without replacement, reproducible from the seed.

    Rows are ordered by a hash of seed and id; the first n are the sample.
    """
    order = [seeded_key(seed, F.col(ident)), F.col(ident)]
    if n <= TOP_N_LIMIT:
        return df.orderBy(*order).limit(n)
    return _sample_by_ranges(df, n, seed, ident)


def _sample_by_ranges(df: DataFrame, n: int, seed: int, ident: str) -> DataFrame:
    """The same sample through counts per key prefix.

    The first five hex digits give at most 16^5 ranges. All ranges before the
    n-th row are taken whole; only the range with the n-th row is ordered.
    """
    keyed = df.withColumn("__key", seeded_key(seed, F.col(ident)))
    prefix = F.substring("__key", 1, 5)
    counts = keyed.groupBy(prefix.alias("__prefix")).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1))
    edge = (
        counts.select("__prefix", "rows", F.coalesce(before, F.lit(0)).alias("before"))
        .where((F.col("before") < n) & (F.col("before") + F.col("rows") >= n))
        .first()
    )
    if edge is None:  # fewer than n rows
        return df
    whole = keyed.where(prefix < edge["__prefix"])
    cut = keyed.where(prefix == edge["__prefix"]).orderBy("__key", ident).limit(n - edge["before"])
    return whole.unionByName(cut).drop("__key")


def sample_runs(df: DataFrame, quotas: dict[int, int], seeds: list[int], label: str = "label", ident: str = "id") -> DataFrame:
    """One stratified sample per seed in a single scan; adds ``run``.

    The result for run r is the union over labels of ``sample_n(.., n, seeds[r])``.
    From the label counts follows a key bound that leaves a few more rows than
    the quota; only those are ordered. Should a bound leave too few, the label
    falls back to one top-n per seed.
    """
    wanted = df.where(F.col(label).isin(*quotas))
    totals = {r[label]: r["rows"] for r in wanted.groupBy(label).agg(F.count("*").alias("rows")).collect()}
    bounds = {}
    for value, n in quotas.items():
        total = totals.get(value, 0)
        share = (n + 8 * n**0.5 + 64) / total if total else 1.0
        bounds[value] = "g" if share >= 1 else f"{int(share * 2**128):032x}"  # "g" is above every hex digit
    bound = F.lit("g")
    for value, text in bounds.items():
        bound = F.when(F.col(label) == value, F.lit(text)).otherwise(bound)
    draws = F.array(*[
        F.struct(F.lit(r).alias("run"), seeded_key(s, F.col(ident)).alias("key")) for r, s in enumerate(seeds)
    ])
    near = hold(
        wanted.withColumn("__bound", bound)
        .withColumn("__draw", F.explode(F.filter(draws, lambda d: d["key"] < F.col("__bound"))))
        .select(*df.columns, F.col("__draw.run").alias("run"), F.col("__draw.key").alias("__key"))
    )
    found = {(r["run"], r[label]): r["rows"] for r in near.groupBy("run", label).agg(F.count("*").alias("rows")).collect()}
    short = [v for v, n in quotas.items() if any(
        found.get((r, v), 0) < min(n, totals.get(v, 0)) for r in range(len(seeds)))]
    quota = F.lit(0)
    for value, n in quotas.items():
        quota = F.when(F.col(label) == value, F.lit(0 if value in short else n)).otherwise(quota)
    # A (run, label) group holds the quota plus a few standard deviations.
    order = Window.partitionBy("run", label).orderBy("__key", ident)
    out = near.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= quota).select(*df.columns, "run")
    for value in short:
        for r, s in enumerate(seeds):
            part = sample_n(df.where(F.col(label) == value), quotas[value], s, ident)
            out = out.unionByName(part.withColumn("run", F.lit(r)))
    return out


def sample_fraction(df: DataFrame, fraction: float, seed: int, ident: str = "id") -> DataFrame:
    """Each row kept with probability ``fraction``; row-wise, no shuffle."""
    return df.where(uniform(seed, F.col(ident)) < fraction)


def stratified_sample(
    df: DataFrame, quotas: dict[int, int], seed: int, label: str = "label", ident: str = "id"
) -> DataFrame:
    """Union of one seeded sample per label value."""
    parts = [sample_n(df.where(F.col(label) == v), n, seed, ident) for v, n in quotas.items()]
    return reduce(DataFrame.unionByName, parts)


def seeded_shuffle(df: DataFrame, seed: int, ident: str = "id") -> DataFrame:
    """All rows in a reproducible random order (a range-partitioned sort)."""
    return df.orderBy(seeded_key(seed, F.col(ident)), F.col(ident))
