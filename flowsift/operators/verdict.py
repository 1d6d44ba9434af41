"""Verdicts: nearest-neighbour summary and statistics to flag and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.functions.numeric import uniform
from flowsift.operators.lsh import LshModel
from flowsift.schema import LshSpec


def verdict_columns(spec: LshSpec, draw: Column | None = None) -> tuple[Column, Column]:
    """``(is_anomaly, score)`` from candidates, distances and the run's statistics.

    ``draw`` is the uniform number of the random criterion (v2). It can change
    a result only when p25 > mean, because criterion 1 has fired otherwise.
    """
    none = F.col("candidates") == 0
    bits = F.lit(float(spec.code_bits))
    avg, low = F.col("avg_distance"), F.col("min_distance").cast("double")
    threshold = F.col("threshold")
    if spec.version == "v1":
        flag = F.when(none, True).otherwise(avg > threshold)
        score = F.when(none, 1.0).otherwise(F.least(avg / (bits * 0.75), F.lit(1.0)))
        return flag, score

    criteria = [
        (low > threshold, F.lit(0.7) + F.lit(0.3) * (low / bits)),
        (avg > threshold * F.lit(1.1), F.lit(0.6) + F.lit(0.4) * (avg / bits)),
        (F.col("candidates") < 5, F.lit(0.75)),
        (low > F.col("p75"), F.lit(0.65)),
    ]
    if draw is not None:
        rise = F.when(F.col("std") > 0, (low - F.col("mean")) / F.col("std") * F.lit(0.1)).otherwise(F.lit(0.3))
        criteria.append(((low > F.col("mean")) & (draw < F.least(rise, F.lit(0.3))), F.lit(0.55)))
    fired = F.lit(False)
    for condition, _ in criteria:
        fired = fired | condition
    best = F.greatest(*[F.when(c, s).otherwise(F.lit(0.0)) for c, s in criteria])
    return (
        F.when(none, True).otherwise(fired),
        F.when(none, 0.90).otherwise(F.least(best, F.lit(1.0))),
    )


def settled(spec: LshSpec, flags_only: bool = False) -> Column | None:
    """Whether some of a query's candidates already give the verdict that all of them give.

    More candidates can only raise their number and lower the smallest distance and the mean of the k
    smallest, once there are k. If no criterion fires on some, none fires on all: the flow is normal, and
    under v2 its score is 0. The score of v1 is the mean distance itself, so only its flag can be settled.
    """
    full = F.col("candidates") >= F.lit(max(spec.neighbours, 5))
    avg, low = F.col("avg_distance"), F.col("min_distance").cast("double")
    if spec.version == "v1":
        return full & (avg <= F.col("threshold")) if flags_only else None
    return (
        full & (low <= F.col("threshold")) & (avg <= F.col("threshold") * F.lit(1.1))
        & (low <= F.col("p75")) & (low <= F.col("mean"))
    )


def with_verdict(neighbours: DataFrame, model: LshModel, seed: int | Column | None = None, ident: str | None = None) -> DataFrame:
    """Add ``is_anomaly`` and ``score`` to rows that carry a kNN summary.

    ``seed`` and ``ident`` turn on the random criterion per row.
    """
    draw = None
    if model.spec.version == "v2" and ident and seed is not None and any(r["p25"] > r["mean"] for r in model.stats):
        draw = uniform(seed, F.col(ident))
    flag, score = verdict_columns(model.spec, draw)
    return model.with_stats(neighbours).select(*neighbours.columns, flag.alias("is_anomaly"), score.alias("score"))
