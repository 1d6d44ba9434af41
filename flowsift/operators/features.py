"""Flow features: totals, rates, shares, category codes, second feature set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowsift.functions.coerce import protocol_code, read_double, read_long, read_text
from flowsift.functions.numeric import ratio
from flowsift.schema import FEATURES, OPTIMIZED_FEATURES, VECTOR8, VECTOR8_TEXT

# A vocabulary up to this many rows (values of one short text column) is broadcast.
BROADCAST_ROWS = 1_000_000
# Positions whose values one task numbers.
POSITIONS = 1_000_000


def service_text(df: DataFrame) -> Column:
    return F.lower(read_text(df, "service", "-"))


def state_text(df: DataFrame) -> Column:
    return F.upper(read_text(df, "state", "other"))


def vocabulary(df: DataFrame, value: Column, pos: str = "id", by: tuple[str, ...] = (), span: int = POSITIONS) -> DataFrame:
    """Codes in order of first appearance, from 1: ``(by..., value, code)``.

    ``pos`` is a number. Rows are reduced to one per value (map-side minimum of the position).
    Values are numbered inside stretches of ``span`` positions, after the values of all earlier
    stretches; only one count per stretch passes an ordered window that isn't cut further.
    Values without a position come first.
    """
    first = df.select(*by, value.alias("value"), F.col(pos).alias("pos")).groupBy(*by, "value").agg(
        F.min("pos").alias("pos")
    )
    first = first.withColumn("__stretch", F.coalesce(F.floor(F.col("pos") / span), F.lit(-(2**62))))
    earlier = Window.partitionBy(*(by or (F.lit(0),))).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = first.groupBy(*by, "__stretch").agg(F.count("*").alias("__n"))
    before = counts.select(*by, "__stretch", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    own = Window.partitionBy(*by, "__stretch").orderBy("pos", "value")
    numbered = first.withColumn("__rank", F.row_number().over(own)).join(before, [*by, "__stretch"])
    return numbered.select(*by, "value", (F.col("__before") + F.col("__rank")).cast("bigint").alias("code"))


def attach_code(
    df: DataFrame, text: Column, vocab: DataFrame, name: str, by: tuple[str, ...] = (),
    unseen: Column | None = None, vocab_rows: int | None = None,
) -> DataFrame:
    """Add the vocabulary code of ``text`` as ``name``; unseen values get ``unseen``.

    The vocabulary is broadcast when its known row count is within
    ``BROADCAST_ROWS``. Without a count, or above the limit, Spark decides from
    run-time sizes and splits hot values (adaptive execution).
    """
    key = f"__{name}"
    codes = vocab.select(*by, F.col("value").alias(key), F.col("code").alias(name))
    if vocab_rows is not None and vocab_rows <= BROADCAST_ROWS:
        codes = F.broadcast(codes)
    joined = df.withColumn(key, text).join(codes, [*by, key], "left").drop(key)
    if unseen is not None:
        joined = joined.withColumn(name, F.coalesce(F.col(name), unseen))
    return joined


class Vocabularies:
    """Service and state codes learned from one table, kept as small tables."""

    def __init__(self, service: DataFrame, state: DataFrame | None, by: tuple[str, ...] = ()):
        self.service, self.state, self.by = service, state, by
        self._sizes: dict[str, int] = {}

    @classmethod
    def learn(cls, flows: DataFrame, by: tuple[str, ...] = (), with_state: bool = True) -> "Vocabularies":
        service = vocabulary(flows, service_text(flows), by=by)
        state = vocabulary(flows, state_text(flows), by=by) if with_state else None
        return cls(service, state, by)

    def freeze(self) -> "Vocabularies":
        """Materialise the codes once, so scoring never relearns them.

        Small vocabularies become local tables; big ones are persisted.
        """
        for name in ("service", "state"):
            table = getattr(self, name)
            if table is None:
                continue
            head = table.limit(BROADCAST_ROWS + 1).persist()
            rows = head.count()
            if rows > BROADCAST_ROWS:
                rows = table.count()  # all of it: the code of unseen values comes after the last
            if rows <= BROADCAST_ROWS:
                local = table.sparkSession.createDataFrame(head.toPandas(), table.schema) if rows else table
                setattr(self, name, local)
            else:
                setattr(self, name, table.persist())
            head.unpersist()
            self._sizes[name] = rows
        return self

    def encode(self, flows: DataFrame) -> DataFrame:
        out = attach_code(flows, service_text(flows), self.service, "service_encoded", self.by,
                          vocab_rows=self._sizes.get("service"))
        if self.state is not None:
            out = attach_code(out, state_text(flows), self.state, "state_encoded", self.by,
                              vocab_rows=self._sizes.get("state"))
        return self._number_unseen(out)

    def release(self) -> None:
        """Drop what ``freeze`` cached."""
        for table in (self.service, self.state):
            if table is not None:
                table.unpersist()

    def _number_unseen(self, out: DataFrame) -> DataFrame:
        for name in ("service", "state"):
            if name in self._sizes and not self.by:
                column = f"{name}_encoded"
                if column in out.columns:
                    out = out.withColumn(column, F.coalesce(column, F.lit(self._sizes[name] + 1).cast("bigint")))
        return out


def flow_features(
    flows: DataFrame,
    vocabularies: Vocabularies | None = None,
    optimized: bool = False,
    keep: tuple[str, ...] = ("id",),
) -> DataFrame:
    """The 22 flow features (or the 9 of the optimised set) beside ``keep`` columns.

    Without ``vocabularies`` the category codes are learned from ``flows``.
    Unseen categories get a code past the vocabulary when it is frozen, else 0.
    """
    vocabularies = vocabularies or Vocabularies.learn(flows, with_state=not optimized)
    src = vocabularies.encode(flows)
    base = src.select(
        *keep,
        read_double(src, "dur").alias("duration"),
        read_long(src, "sbytes").alias("src_bytes"),
        read_long(src, "dbytes").alias("dst_bytes"),
        read_long(src, "spkts").alias("src_packets"),
        read_long(src, "dpkts").alias("dst_packets"),
        protocol_code(src).alias("protocol"),
        F.coalesce(F.col("service_encoded"), F.lit(0).cast("bigint")).alias("service_encoded"),
        *(
            [F.coalesce(F.col("state_encoded"), F.lit(0).cast("bigint")).alias("state_encoded")]
            if "state_encoded" in src.columns else []
        ),
        read_double(src, "sload").alias("src_load"),
        read_double(src, "dload").alias("dst_load"),
        read_double(src, "smean").alias("mean_packet_size"),
        read_long(src, "trans_depth").alias("trans_depth"),
        read_long(src, "ct_src_dport_ltm").alias("ct_src_dport_ltm"),
        read_long(src, "ct_dst_sport_ltm").alias("ct_dst_sport_ltm"),
    )
    total_bytes = F.col("src_bytes") + F.col("dst_bytes")
    total_packets = F.col("src_packets") + F.col("dst_packets")
    derived = {
        "total_bytes": total_bytes,
        "total_packets": total_packets,
        "bytes_per_packet": ratio(total_bytes, total_packets),
        "bytes_per_second": ratio(total_bytes, F.col("duration")),
        "packets_per_second": ratio(total_packets, F.col("duration")),
        "src_bytes_ratio": ratio(F.col("src_bytes"), total_bytes, 0.5),
        "src_packets_ratio": ratio(F.col("src_packets"), total_packets, 0.5),
        "load_ratio": ratio(F.col("src_load"), F.col("dst_load")),
    }
    names = OPTIMIZED_FEATURES if optimized else FEATURES
    return base.select(*keep, *[derived[n].alias(n) if n in derived else F.col(n) for n in names])


def feature_columns(df: DataFrame) -> list[str]:
    """Feature columns of a projected table in matrix order (sorted names)."""
    known = set(FEATURES)
    return sorted(c for c in df.columns if c in known)


def feature_matrix(features: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Dense vector per row: features in sorted name order, missing as 0."""
    names = feature_columns(features)
    cells = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]
    return features.select(*keep, F.array(*cells).alias("features"))


def feature_long(features: DataFrame, names: tuple[str, ...], keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row per (flow, feature)."""
    wide = features.select(*keep, *[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot([F.col(k) for k in keep], [F.col(n) for n in names], "feature", "value")


def flow_vector8(flows: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Second feature set: eight numbers and three texts, falsy cells as 0 or ''."""
    return flows.select(
        *keep,
        *[read_double(flows, n).alias(n) for n in VECTOR8],
        *[read_text(flows, n, "").alias(n) for n in VECTOR8_TEXT],
    )


def record_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The record as JSON, keys sorted."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns or df.columns)]))


def content_id(df: DataFrame, columns: list[str] | None = None, id_column: str = "id") -> Column:
    """The record's own id, or a hash of its content where there is none."""
    hashed = F.md5(record_json(df, [c for c in (columns or df.columns) if c != id_column]))
    if id_column not in df.columns:
        return hashed
    own = F.col(id_column).cast("string")
    return F.when(own.isin("", "0"), hashed).otherwise(F.coalesce(own, hashed))


def enrich(flows: DataFrame, training: bool = True) -> DataFrame:
    """Typed record for a flow store: vector8, id, label flag, description, score."""
    out = flow_vector8(flows, keep=())
    label = read_long(flows, "label").cast("int")
    numbers = [read_double(flows, n).alias(n) for n in VECTOR8]
    texts = [read_text(flows, n, "").alias(n) for n in VECTOR8_TEXT]
    typed = flows.select(*numbers, *texts, content_id(flows).alias("flow_id"), label.alias("label"))
    typed = typed.withColumn("is_anomaly", F.col("label") == 1)
    return typed.select(
        *out.columns, "flow_id", "label", "is_anomaly",
        record_json(typed).alias("flow_description"),
        F.lit(0.0).alias("anomaly_score"),
        F.lit(training).alias("training_set"),
    )


def flow_match_key(df: DataFrame) -> Column:
    """Comma list of match fields of a flow; null where the protocol is not text."""

    def part(prefix: str, name: str, default: str) -> Column:
        if name not in df.columns:
            return F.lit(f"{prefix}={default}")
        text = F.col(name).cast("string")
        return F.when(text.isNotNull() & ~text.isin("", "0"), F.concat(F.lit(f"{prefix}="), text))

    proto = F.lower(F.col("proto")) if "proto" in df.columns else F.lit("tcp")

    def ports(kind: str, number: int) -> list[Column]:
        fields = [F.lit(f"ip_proto={number}"), part(f"{kind}_src", "sport", "80"), part(f"{kind}_dst", "dsport", "443")]
        return [F.when(proto == kind, f) for f in fields]

    # concat_ws leaves out the null parts.
    pieces = [part("ip_src", "srcip", "192.168.1.1"), part("ip_dst", "dstip", "192.168.1.2"),
              *ports("tcp", 6), *ports("udp", 17)]
    return F.when(proto.isNotNull(), F.concat_ws(",", *pieces))
