"""Small column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grid(value: Column, step: float = 1e6) -> Column:
    """Round half up on a decimal grid; the same arithmetic in every SQL engine."""
    moved = value * F.lit(step) + F.lit(0.5)
    # Spark's floor is a bigint and ends at 2^63; from 2^52 on every double is whole already.
    return F.when(F.abs(moved) < F.lit(2.0**52), F.floor(moved).cast("double")).otherwise(moved) / F.lit(step)


def positive(value: Column) -> Column:
    """``value > 0`` that is false for NaN."""
    return ~F.isnan(value) & (value > 0)


def ratio(top: Column, bottom: Column, otherwise: float = 0.0) -> Column:
    """``top / bottom`` where the bottom is positive, else a constant."""
    bottom = bottom.cast("double")
    return F.when(positive(bottom), top.cast("double") / bottom).otherwise(F.lit(otherwise))


def seeded_key(seed: Column | int, ident: Column) -> Column:
    """Pseudo-random order key of a row; depends on seed and id only."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), ident.cast("string")))


def uniform(seed: int | Column, ident: Column) -> Column:
    """Reproducible uniform draw in [0, 1) from the seeded key."""
    head = F.conv(F.substring(seeded_key(seed, ident), 1, 8), 16, 10).cast("double")
    return head / F.lit(4294967296.0)


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two codes."""
    return F.bit_count(a.bitwiseXOR(b))


def sign_code(vector: Column) -> Column:
    """One bit per dimension of a float vector, set where the value is positive.

    An array of 64-bit words, as many as the vector's own length needs; bit 0 of
    word 0 is the first dimension. An empty vector has no words.
    """
    words = F.sequence(F.lit(0), F.ceil(F.size(vector) / 64).cast("int") - 1)

    def word(w: Column) -> Column:
        part = F.slice(vector, w * 64 + 1, F.lit(64))
        bits = F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))

    return F.when(F.size(vector) > 0, F.transform(words, word)).when(F.size(vector) == 0, F.array().cast("array<bigint>"))


def hamming_words(a: Column, b: Column) -> Column:
    """Number of differing bits of two arrays of words of equal length."""
    return F.aggregate(F.zip_with(a, b, hamming), F.lit(0), lambda total, n: total + n)
