"""Column layouts and parameter records shared by the whole package."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Raw flow columns and their types.
FLOW = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("dur", T.DoubleType()),
        T.StructField("proto", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("spkts", T.LongType()),
        T.StructField("dpkts", T.LongType()),
        T.StructField("sbytes", T.LongType()),
        T.StructField("dbytes", T.LongType()),
        T.StructField("rate", T.DoubleType()),
        T.StructField("sttl", T.IntegerType()),
        T.StructField("dttl", T.IntegerType()),
        T.StructField("sload", T.DoubleType()),
        T.StructField("dload", T.DoubleType()),
        T.StructField("smean", T.StringType()),
        T.StructField("trans_depth", T.IntegerType()),
        T.StructField("ct_src_dport_ltm", T.IntegerType()),
        T.StructField("ct_dst_sport_ltm", T.IntegerType()),
        T.StructField("label", T.IntegerType()),
    ]
)
FLOW_RAW = T.StructType([T.StructField(f.name, T.StringType()) for f in FLOW])

# Feature names of the full and the reduced projection.
FEATURES = (
    "duration", "src_bytes", "dst_bytes", "src_packets", "dst_packets",
    "protocol", "service_encoded", "state_encoded", "total_bytes",
    "total_packets", "bytes_per_packet", "bytes_per_second",
    "packets_per_second", "src_bytes_ratio", "src_packets_ratio", "src_load",
    "dst_load", "load_ratio", "mean_packet_size", "trans_depth",
    "ct_src_dport_ltm", "ct_dst_sport_ltm",
)
OPTIMIZED_FEATURES = (
    "total_packets", "protocol", "bytes_per_packet", "duration", "total_bytes",
    "packets_per_second", "service_encoded", "dst_load", "mean_packet_size",
)
VECTOR8 = ("dur", "sbytes", "dbytes", "spkts", "dpkts", "rate", "sttl", "dttl")
VECTOR8_TEXT = ("proto", "service", "state")

# Order in which features enter the v1 code.
PRIORITY_V1 = (
    "total_bytes", "total_packets", "duration", "bytes_per_packet",
    "src_bytes_ratio", "packets_per_second", "protocol", "service_encoded",
    "state_encoded", "load_ratio", "src_load", "dst_load",
)

# Seeds of the repeated experiment.
EXPERIMENT_SEEDS = (355, 1307, 6390, 9026, 2997, 9766, 1095, 4926, 276, 8706)

LSH_MODEL = "Flow_Aware_LSH"
LSH_MODEL_V1 = "Binary_LSH"
IFOREST_MODEL = "Isolation_Forest"
OCSVM_MODEL = "One_Class_SVM"
LOF_MODEL = "local_outlier_factor"


@dataclass(frozen=True)
class BinRule:
    """How one numeric feature is binned.

    ``kind`` is ``log`` (quantiles of log10(v+1)), ``plain`` (quantiles),
    ``trimmed`` (quantiles between the 1st and 99th percentile) or
    ``dispersion`` (log with ``bits`` if std > mean, else plain with
    ``bits_linear``).
    """

    kind: str
    bits: int
    bits_linear: int = 0


@dataclass(frozen=True)
class QuantizerSpec:
    features: tuple[str, ...]
    categorical: tuple[str, ...]
    priority: tuple[str, ...]
    rules: dict[str, BinRule] = field(hash=False)
    default_rule: BinRule = BinRule("plain", 6)
    min_category_bits: int = 0
    max_category_bits: int = 8
    drop_zeros: bool = False
    min_support: int = 10
    code_bits: int = 64

    def rule(self, feature: str) -> BinRule:
        return self.rules.get(feature, self.default_rule)

    def without(self, feature: str) -> "QuantizerSpec":
        """The same rules with one feature removed."""
        return QuantizerSpec(
            tuple(f for f in self.features if f != feature),
            tuple(f for f in self.categorical if f != feature),
            tuple(f for f in self.priority if f != feature),
            self.rules, self.default_rule, self.min_category_bits,
            self.max_category_bits, self.drop_zeros, self.min_support,
            self.code_bits,
        )


QUANTIZER_V2 = QuantizerSpec(
    features=OPTIMIZED_FEATURES,
    categorical=("protocol", "service_encoded"),
    priority=OPTIMIZED_FEATURES,
    rules={
        "total_packets": BinRule("log", 10),
        "total_bytes": BinRule("log", 10),
        "bytes_per_packet": BinRule("trimmed", 8),
        "packets_per_second": BinRule("trimmed", 8),
        "duration": BinRule("dispersion", 8, 6),
    },
    min_category_bits=2,
    max_category_bits=8,
)

QUANTIZER_V1 = QuantizerSpec(
    features=FEATURES,
    categorical=("protocol", "service_encoded", "state_encoded"),
    priority=PRIORITY_V1,
    rules={
        "total_bytes": BinRule("trimmed", 6),
        "total_packets": BinRule("trimmed", 6),
        "bytes_per_packet": BinRule("trimmed", 6),
        "duration": BinRule("trimmed", 6),
    },
    default_rule=BinRule("trimmed", 4),
    max_category_bits=4,
    drop_zeros=True,
)


@dataclass(frozen=True)
class LshSpec:
    """Shape of the hash family, the distance sample and the verdict rule."""

    version: str
    tables: int
    functions: int
    code_bits: int
    neighbours: int
    sample: int
    anchors: int
    band: int
    default_mean: float
    default_std: float
    default_percentiles: tuple[float, ...] = (16.0, 24.0, 32.0, 40.0, 48.0)
    probe_tables: int = 0
    probe_keys: int = 0
    probe_bits: int = 0


LSH_V2 = LshSpec("v2", 16, 20, 64, 20, 2000, 1000, 9, 32.0, 8.0,
                 probe_tables=3, probe_keys=50, probe_bits=2)
LSH_V1 = LshSpec("v1", 8, 12, 64, 10, 1000, 500, 19, 16.0, 4.0)
