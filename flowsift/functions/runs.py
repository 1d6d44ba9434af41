"""Per-run metadata beside data rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _constant(value, kind: str) -> Column:
    if kind.startswith("array<"):
        # One string to parse instead of a call per element; Spark folds it to a literal.
        joined = ",".join(map(str, value))
        return F.expr(f"cast(split('{joined}', ',') as {kind})") if len(value) else F.expr(f"cast(array() as {kind})")
    return F.lit(value).cast(kind)


def attach_run(df: DataFrame, rows: dict[int, dict], kinds: dict[str, str]) -> DataFrame:
    """Add metadata columns by ``run``.

    One run needs no join: its values are constants. Several runs are a broadcast
    table with one row each.
    """
    if len(rows) == 1:
        values = next(iter(rows.values()))
        return df.select("*", *[_constant(values[c], k).alias(c) for c, k in kinds.items()])
    schema = ", ".join(["run int", *[f"{c} {k}" for c, k in kinds.items()]])
    table = df.sparkSession.createDataFrame([(r, *[v[c] for c in kinds]) for r, v in rows.items()], schema)
    return df.join(F.broadcast(table), "run")
