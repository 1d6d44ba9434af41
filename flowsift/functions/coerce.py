"""Tolerant casts: missing markers and unreadable cells become a default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING_MARKERS = ("-", "", "nan")  # fixed values
# Java number parsing takes type suffixes and hex floats; such cells are text here.
_NOT_A_NUMBER = r"[xX]|[0-9.]\s*[dDfF]\s*$"


def double_or(text: Column, default: float = 0.0) -> Column:
    """A string column as double, ``default`` where it is missing or unreadable."""
    digits = F.regexp_replace(text, r"(?<=[0-9])_(?=[0-9])", "")
    parsed = F.when(~text.rlike(_NOT_A_NUMBER), digits.try_cast("double"))
    return F.when(text.isin(*MISSING_MARKERS), F.lit(default)).otherwise(
        F.coalesce(parsed, F.lit(default))
    )


def long_or(value: Column, default: int = 0) -> Column:
    """A double column truncated toward zero; NaN and infinities become ``default``."""
    finite = ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.coalesce(F.when(finite, value.try_cast("bigint")), F.lit(default).cast("bigint"))


def read_double(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """Column ``name`` of ``df`` as double, whatever its type; absent means default."""
    if name not in df.columns:
        return F.lit(float(default))
    if isinstance(df.schema[name].dataType, T.StringType):
        return double_or(F.col(name), float(default))
    return F.coalesce(F.col(name).cast("double"), F.lit(float(default)))


def read_long(df: DataFrame, name: str, default: int = 0) -> Column:
    """Column ``name`` of ``df`` as bigint, whatever its type; absent means default."""
    if name not in df.columns:
        return F.lit(default).cast("bigint")
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return F.coalesce(F.col(name).cast("bigint"), F.lit(default).cast("bigint"))
    if isinstance(kind, T.StringType):
        missing = F.coalesce(F.col(name).isin(*MISSING_MARKERS), F.lit(True))
        number = long_or(double_or(F.col(name), float("nan")), default)
        return F.when(missing, F.lit(default).cast("bigint")).otherwise(number)
    return long_or(F.col(name).cast("double"), default)


def read_text(df: DataFrame, name: str, default: str) -> Column:
    """Column ``name`` as string; absent or null means default."""
    if name not in df.columns:
        return F.lit(default)
    return F.coalesce(F.col(name).cast("string"), F.lit(default))


def coerce_label(df: DataFrame) -> DataFrame:
    """Turn ``label`` into int, 0 where unreadable; no change without that column."""
    if "label" not in df.columns:
        return df
    return df.withColumn("label", read_long(df, "label").cast("int"))


def protocol_code(df: DataFrame) -> Column:
    """tcp 1, udp 2, icmp 3, everything else 1."""
    proto = F.lower(read_text(df, "proto", "tcp"))
    return F.when(proto == "udp", 2).when(proto == "icmp", 3).otherwise(1).cast("bigint")
