"""Cached tables with an owner: what is cached inside a scope is released at its end."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

_local = threading.local()


def hold(df: DataFrame) -> DataFrame:
    """Cache a table; the innermost open scope of this thread releases it."""
    df = df.persist()
    scopes = getattr(_local, "scopes", None)
    if scopes:
        scopes[-1].append(df)
    return df


@contextmanager
def held_tables() -> Iterator[None]:
    """Owns what ``hold`` caches until the block ends; results must be used up or written by then."""
    scopes = _local.scopes = getattr(_local, "scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for df in scopes.pop():
            df.unpersist()
