"""Flow table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from flowsift.functions.coerce import coerce_label
from flowsift.schema import FLOW, FLOW_RAW

TRAIN_UNTIL = "2024-01-22"  # flows seen before this day form the training period


def read_flows(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    raw: bool = False,
) -> DataFrame | None:
    """Scan a flow table with a fixed schema; None if the location is absent.

    ``raw`` reads CSV cells as text, so the tolerant casts see the markers.
    The label is coerced on the way in.
    """
    schema = schema or (FLOW_RAW if raw else FLOW)
    reader = spark.read.schema(schema)
    try:
        if fmt == "csv":
            # Columns are matched by the header line, not by their position.
            header = spark.read.option("header", True).csv(path).columns
            kinds = {f.name: f.dataType for f in schema}
            ordered = T.StructType(
                [T.StructField(c, kinds.get(c, T.StringType())) for c in header]
            )
            df = spark.read.schema(ordered).option("header", True).option("mode", "PERMISSIVE").csv(path)
        else:
            df = reader.format(fmt).load(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err):
            return None
        raise
    return coerce_label(df)


def flows_from_events(events: DataFrame) -> DataFrame:
    """View an ``events`` table as network flows (one row per event)."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    base = events.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    sized = base.select(
        "*",
        (1 + F.col("k")).cast("bigint").alias("spkts"),
        ((F.col("event_id") * 7) % 40).cast("bigint").alias("dpkts"),
        F.when(F.col("event_id") % 50 == 0, F.lit(0.0))
        .otherwise(F.col("value") * F.col("value") / F.lit(10000.0))
        .alias("dur"),
    )
    full = sized.select(
        "*",
        F.floor(F.col("value") * F.col("spkts")).cast("bigint").alias("sbytes"),
        (F.col("dpkts") * (40 + F.col("user_id"))).cast("bigint").alias("dbytes"),
    )

    def per_second(amount):
        return F.when(F.col("dur") > 0, amount / F.col("dur")).otherwise(F.lit(0.0))

    proto = F.col("k") % 5
    return full.select(
        F.col("event_id").alias("id"),
        "ts",
        "dur",
        F.when(proto == 0, "UDP").when(proto == 1, "icmp").when(proto == 2, "arp").otherwise("tcp").alias("proto"),
        F.when(F.col("user_id") % 13 == 0, "-")
        .otherwise(F.concat(F.lit("svc"), (F.col("user_id") % 13).cast("string")))
        .alias("service"),
        F.col("event_type").alias("state"),
        "spkts",
        "dpkts",
        "sbytes",
        "dbytes",
        per_second((F.col("spkts") + F.col("dpkts")).cast("double")).alias("rate"),
        F.when(F.col("k") % 2 == 0, 254).otherwise(62).cast("int").alias("sttl"),
        F.when(F.col("event_id") % 2 == 0, 252).otherwise(0).cast("int").alias("dttl"),
        per_second((F.col("sbytes") * 8).cast("double")).alias("sload"),
        per_second((F.col("dbytes") * 8).cast("double")).alias("dload"),
        F.when(F.col("event_id") % 97 == 0, "-")
        .otherwise(F.floor("value").cast("bigint").cast("string"))
        .alias("smean"),
        (F.col("user_id") % 3).cast("int").alias("trans_depth"),
        (1 + F.col("k") % 10).cast("int").alias("ct_src_dport_ltm"),
        (1 + F.col("user_id") % 6).cast("int").alias("ct_dst_sport_ltm"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).cast("int").alias("label"),
        F.when(F.col("ts") < F.lit(TRAIN_UNTIL).cast("date"), "train").otherwise("test").alias("split"),
    )


def event_flows(
    spark: SparkSession, sf_dir: str, split: str | None = None, label: int | None = None
) -> DataFrame:
    """Flows of one scale folder; ``split`` and ``label`` filter the scan itself.

    The conditions are put on the raw columns, so Parquet can skip row groups.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cut = F.lit(TRAIN_UNTIL).cast("date").cast("timestamp_ntz")
    if split is not None:
        events = events.where(F.col("ts") < cut if split == "train" else F.col("ts") >= cut)
    if label is not None:
        events = events.where(F.col("event_type") == "error" if label else F.col("event_type") != "error")
    return flows_from_events(events)
