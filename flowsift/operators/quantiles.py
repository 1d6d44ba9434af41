"""Exact quantiles by distributed ranks.

Values are first reduced to ``(group, value, count)`` with map-side
aggregation, so a value held by a third of all rows becomes one row. Ranks are
running sums of the counts. Small tables use one window per group; big ones
cut each group's value range into buckets, sum the buckets, and run one window
per bucket, so no task holds a whole group.

Interpolation follows the usual linear rule on ``(n - 1) * q``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from flowsift.functions.held import hold
from pyspark.sql.window import Window

# Distinct (group, value) rows that one window per group may handle.
SINGLE_WINDOW_ROWS = 2_000_000
# Aim for this many distinct values per bucket above that.
BUCKET_ROWS = 500_000
MAX_BUCKETS = 4096


def value_counts(long: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    return long.groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("cnt"))


def left_search(thresholds: Column, value: Column, slots: int) -> Column:
    """Number of sorted ``thresholds`` strictly below ``value`` (binary search)."""
    steps, step = [], 1
    while step * 2 <= slots:
        step *= 2
    while step:
        steps.append(step)
        step //= 2
    size = F.size(thresholds)
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda pos, s: F.when(
            (pos + s <= size) & (F.get(thresholds, F.least(pos + s, size) - 1) < value), pos + s
        ).otherwise(pos),
    )


def cumulative(
    counts: DataFrame, by: Sequence[str], sums: Sequence[str] = ("cnt",), value: str = "value",
    rows: int | None = None,
) -> DataFrame:
    """Add ``<c>_before``: sum of ``c`` over smaller values of the same group.

    ``counts`` has one row per (group, value). ``rows`` is its size if known;
    the bucketed way is taken above ``SINGLE_WINDOW_ROWS``.
    """
    by = list(by)
    rows = counts.count() if rows is None else rows
    if rows <= SINGLE_WINDOW_ROWS:
        order = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select("*", *[
            F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"{c}_before") for c in sums
        ])

    buckets = min(MAX_BUCKETS, max(2, -(-rows // BUCKET_ROWS)))
    points = [i / buckets for i in range(1, buckets)]
    # The splitters only balance the buckets; ranks do not depend on their accuracy.
    splits = counts.groupBy(*by).agg(
        F.percentile_approx(value, points, F.lit(10 * buckets)).alias("__splits")
    )
    splits = counts.sparkSession.createDataFrame(splits.collect(), splits.schema)
    placed = (
        counts.join(F.broadcast(splits), by)
        .withColumn("__bucket", left_search(F.col("__splits"), F.col(value), buckets))
        .drop("__splits")
    )
    totals = placed.groupBy(*by, "__bucket").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    earlier = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__bucket", *[
        F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}_offset") for c in sums
    ])
    inside = Window.partitionBy(*by, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    # offsets: at most MAX_BUCKETS rows per group, and groups are features, models or seeds.
    return placed.join(F.broadcast(offsets), [*by, "__bucket"]).select(
        *counts.columns,
        *[
            (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"__{c}_offset")).alias(f"{c}_before")
            for c in sums
        ],
    )


def lerp(low: Column, high: Column, weight: Column) -> Column:
    """Linear interpolation, computed from the nearer end."""
    gap = high - low
    return F.when(weight >= 0.5, high - gap * (F.lit(1.0) - weight)).otherwise(low + gap * weight)


def _neighbours(low: Column, rows: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """Whether a value's ranks ``first..last`` hold the low rank, and the next one."""
    return low.between(first, last), F.least(low + 1, rows - 1).between(first, last)


def point_values(ranked: DataFrame, by: Sequence[str], points: Sequence[float], rows: Column) -> DataFrame:
    """A few quantiles per group as columns ``q0, q1, ...``.

    ``ranked`` comes from :func:`cumulative` and carries ``rows``, the number of
    values of the group. ``below0, below1, ...`` and ``upto0, upto1, ...`` count
    the values below the quantile and those up to it.
    """
    first, last = F.col("cnt_before"), F.col("cnt_before") + F.col("cnt") - 1
    entry = F.struct(F.col("value").alias("v"), first.alias("below"), (last + 1).alias("upto"))
    ends, results = [], []
    for k, q in enumerate(points):
        place = (rows - 1).cast("double") * F.lit(float(q))
        at_low, at_high = _neighbours(F.floor(place).cast("bigint"), rows, first, last)
        ends += [
            F.max(F.when(at_low, entry)).alias(f"__low{k}"),
            F.max(F.when(at_high, entry)).alias(f"__high{k}"),
            F.max(place - F.floor(place)).alias(f"__weight{k}"),
        ]
        low, high = F.col(f"__low{k}"), F.col(f"__high{k}")
        value = lerp(low["v"], high["v"], F.col(f"__weight{k}"))
        results += [
            value.alias(f"q{k}"),
            F.when(value > low["v"], high["below"]).otherwise(low["below"]).alias(f"below{k}"),
            F.when(value < high["v"], low["upto"]).otherwise(high["upto"]).alias(f"upto{k}"),
        ]
    return ranked.groupBy(*by).agg(*ends).select(*by, *results)


def grid_points(
    ranked: DataFrame, by: Sequence[str], levels: str, rows: Column, skip: Column, transform: Column
) -> DataFrame:
    """Quantiles at ``levels`` equally spaced percentages 0..100 of each group.

    ``ranked`` comes from :func:`cumulative`; column ``levels`` is the number of
    points of the row's group; ``rows`` the number of values after leaving
    out ``skip`` smallest ones; ``transform`` a monotone function of
    ``value``. Result: ``(by..., i, threshold)``.

    Each distinct value works out for itself which points fall on its ranks, so
    there is no join between values and points.
    """
    count = F.col(levels)
    first = F.col("cnt_before") - skip
    last = first + F.col("cnt") - 1
    top = rows - 1

    def fraction(i: Column, count: Column) -> Column:
        step = F.lit(100.0) / (count - 1).cast("double")
        return F.when(i == count - 1, F.lit(1.0)).otherwise(i.cast("double") * step / F.lit(100.0))

    # Estimated range of points on [first - 1, last]; one more on both sides for rounding.
    per_rank = (count - 1).cast("double") / F.greatest(top, F.lit(1)).cast("double")
    start = F.greatest(F.floor((first - 1).cast("double") * per_rank).cast("int") - 1, F.lit(0))
    stop = F.least(F.ceil((last + 1).cast("double") * per_rank).cast("int") + 1, count.cast("int") - 1)
    inside = (last >= 0) & (first <= top) & (start <= stop)

    def hit(i: Column) -> Column:
        low = F.floor(top.cast("double") * fraction(i, count)).cast("bigint")
        at_low, at_high = _neighbours(low, rows, first, last)
        return F.struct(i.alias("i"), at_low.alias("at_low"), at_high.alias("at_high"))

    hits = F.filter(F.transform(F.sequence(start, stop), hit), lambda h: h["at_low"] | h["at_high"])
    ends = (
        ranked.where(inside)
        .select(*by, transform.alias("__moved"), count.alias("__levels"), top.alias("__top"), F.explode(hits).alias("hit"))
        .groupBy(*by, F.col("hit.i").alias("i"))
        .agg(
            F.first("__levels").alias("__levels"),
            F.first("__top").alias("__top"),
            F.max(F.when(F.col("hit.at_low"), F.col("__moved"))).alias("low"),
            F.max(F.when(F.col("hit.at_high"), F.col("__moved"))).alias("high"),
        )
    )
    place = F.col("__top").cast("double") * fraction(F.col("i"), F.col("__levels"))
    return ends.select(*by, "i", lerp(F.col("low"), F.col("high"), place - F.floor(place)).alias("threshold"))


def exact_quantiles(df: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., q0, q1, ...)``: exact quantiles of one column."""
    keys = list(by) or ["__all"]
    keyed = df if by else df.withColumn("__all", F.lit(0))
    keyed = keyed.select(*keys, F.col(value).cast("double").alias("value")).where(~F.isnan("value"))
    counts = hold(value_counts(keyed, keys))
    totals = counts.groupBy(*keys).agg(F.sum("cnt").alias("rows"))
    ranked = cumulative(counts, keys).join(F.broadcast(totals), keys)
    out = point_values(ranked, keys, points, F.col("rows"))
    return out.select(*by, *[f"q{k}" for k in range(len(points))])
