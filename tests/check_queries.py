"""Run registered queries beside their SQL checks and compare all values.

``python tests/check_queries.py [folder] [name ...]``
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(cell(x) for x in v) + "]"
        if hasattr(v, "is_integer") or type(v).__name__ == "Decimal":
            return repr(float(v))
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, sf_dir: str, name: str, query, text: str | None):
    start = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if text is None:
        return "rows only", took, len(rows), ""
    result = con.execute(text)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return "COLUMNS", took, len(rows), f"{sorted(df.columns)} / {sorted(names)}"
    a, b = canonical(rows, df.columns), canonical(expected, names)
    if a == b:
        return "equal", took, len(rows), ""
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return "DIFFERENT", took, len(rows), f"{len(a)}/{len(b)} rows, {len(only_a)} differ: {only_a[:2]} / {only_b[:2]}"


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as e

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(e.queries())
    spark, con, texts = session(), duck(folder), e.oracle_sql()
    for name in wanted:
        try:
            status, took, n, note = compare(spark, con, folder, name, e.queries()[name], texts.get(name))
        except Exception as err:  # report and go on with the next query
            status, took, n, note = "ERROR", 0.0, 0, str(err)[:600]
        print(f"{name:26s} {status:10s} {took:6.1f}s {n:7d} rows {note}", flush=True)
