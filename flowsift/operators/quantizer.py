"""Learned binning of flow features and packing of the bins into one code."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.operators.features import feature_long
from flowsift.operators.quantiles import cumulative, grid_points, left_search, point_values, value_counts
from flowsift.schema import QUANTIZER_V1, QUANTIZER_V2, QuantizerSpec

DEFAULT_BITS = 2  # width of a feature without parameters (always bin 0)

PARAMS = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("bits", T.IntegerType()),
        T.StructField("n_values", T.LongType()),
        T.StructField("thresholds", T.ArrayType(T.DoubleType())),
        T.StructField("categories", T.ArrayType(T.DoubleType())),
        T.StructField("min_val", T.DoubleType()),
        T.StructField("max_val", T.DoubleType()),
    ]
)


def fit_bins(features: DataFrame, spec: QuantizerSpec = QUANTIZER_V2, by: tuple[str, ...] = ()) -> list[dict]:
    """Bin parameters of every feature (and of every ``by`` group), as dicts.

    NaN is left out (and zeros under v1); a feature with fewer than ten values
    has no entry. All features and groups are fitted together from one table of
    value counts. What comes to the driver is metadata: a summary row per
    feature, then its thresholds (at most 1024 numbers).
    """
    keys = [*by, "feature"]
    long = feature_long(features, spec.features, keep=by).where(~F.isnan("value"))
    if spec.drop_zeros:
        long = long.where(F.col("value") != 0)
    counts = value_counts(long, keys).persist()
    weighted = F.col("cnt") * F.col("value")
    summary = counts.groupBy(*keys).agg(
        F.count("*").alias("distinct"),
        F.sum("cnt").alias("n"),
        (F.sum(weighted) / F.sum("cnt")).alias("mean"),
        (F.sum(weighted * F.col("value")) / F.sum("cnt")).alias("mean_square"),
        F.sort_array(F.collect_set(F.when(F.col("feature").isin(*spec.categorical), F.col("value")))).alias("categories"),
    ).collect()

    fitted, numeric, trimmed = {}, [], []
    for row in summary:
        if row["n"] < spec.min_support:
            continue
        key = tuple(row[k] for k in keys)
        kind, bits = _kind_and_bits(spec, row)
        fitted[key] = {
            **dict(zip(keys, key)), "type": _TYPES[kind], "bits": bits, "n_values": row["n"],
            "thresholds": None, "categories": list(row["categories"]) if kind == "categorical" else None,
            "min_val": None, "max_val": None,
        }
        if kind == "trimmed":
            trimmed.append((*key, row["n"]))
        if kind != "categorical":
            numeric.append((*key, row["n"], 0, kind, 1 << bits))

    session = features.sparkSession
    schema = ", ".join(f"{k} {features.schema[k].dataType.simpleString()}" for k in by)
    schema = f"{schema}, feature string" if schema else "feature string"
    ranked = cumulative(counts, keys, rows=sum(row["distinct"] for row in summary)) if numeric else None

    kept: dict[tuple, tuple[int, int]] = {}
    if trimmed:
        listed = session.createDataFrame(trimmed, f"{schema}, n bigint")
        limits = point_values(ranked.join(F.broadcast(listed), keys), keys, [1 / 100, 99 / 100], F.col("n"))
        for row in limits.collect():
            key = tuple(row[k] for k in keys)
            fitted[key]["min_val"], fitted[key]["max_val"] = row["q0"], row["q1"]
            kept[key] = (row["upto1"] - row["below0"], row["below0"])
    if numeric:
        size = len(keys)
        goals = [(*g[:size], *kept.get(g[:size], g[size:size + 2]), *g[size + 2:]) for g in numeric]
        listed = session.createDataFrame(goals, f"{schema}, n bigint, skip bigint, kind string, levels int")
        points = grid_points(
            ranked.join(F.broadcast(listed), keys), keys, "levels", F.col("n"), F.col("skip"),
            F.when(F.col("kind") == "log", F.log10(F.col("value") + 1)).otherwise(F.col("value")),
        )
        lists = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "threshold"))).alias("points"))
        for row in lists.collect():
            fitted[tuple(row[k] for k in keys)]["thresholds"] = [p["threshold"] for p in row["points"]]
    counts.unpersist()
    return list(fitted.values())


_TYPES = {
    "categorical": "categorical", "log": "log_continuous", "trimmed": "adaptive_continuous",
    "plain": "continuous", "linear": "continuous",
}


def _kind_and_bits(spec: QuantizerSpec, row: Row) -> tuple[str, int]:
    """Kind and width of one feature from its summary row."""
    if row["feature"] in spec.categorical:
        # Smallest b with 2^b >= n + 1.
        needed = len(row["categories"]).bit_length()
        return "categorical", min(spec.max_category_bits, max(spec.min_category_bits, needed))
    rule = spec.rule(row["feature"])
    if rule.kind != "dispersion":
        return rule.kind, rule.bits
    # std > mean, without the cancelling subtraction: E[v^2] - m^2 > m^2.
    spread = row["mean"] < 0 or row["mean_square"] > 2 * row["mean"] ** 2
    return ("log", rule.bits) if spread else ("linear", rule.bits_linear)


def quantizer_params(features: DataFrame, spec: QuantizerSpec = QUANTIZER_V2) -> DataFrame:
    """The fitted parameters as a table, one row per feature."""
    return features.sparkSession.createDataFrame(fit_bins(features, spec), PARAMS)


@dataclass(frozen=True)
class FeatureBins:
    """Parameters of one fitted feature (metadata, at most a few KB)."""

    feature: str
    type: str
    bits: int
    n_values: int
    thresholds: tuple[float, ...] | None = None
    categories: tuple[float, ...] | None = None
    min_val: float | None = None
    max_val: float | None = None

    @property
    def levels(self) -> int:
        return len(self.thresholds if self.thresholds is not None else self.categories)


class QuantizerModel:
    """Fitted bins and the frozen bit layout of the code."""

    def __init__(self, spec: QuantizerSpec, bins: dict[str, FeatureBins]):
        self.spec, self.bins = spec, bins

    @classmethod
    def from_rows(cls, spec: QuantizerSpec, rows: list) -> "QuantizerModel":
        def tup(v):
            return None if v is None else tuple(v)

        bins = {
            r["feature"]: FeatureBins(r["feature"], r["type"], r["bits"], r["n_values"], tup(r["thresholds"]),
                                      tup(r["categories"]), r["min_val"], r["max_val"])
            for r in rows
        }
        return cls(spec, bins)

    def bits(self, feature: str) -> int:
        return self.bins[feature].bits if feature in self.bins else DEFAULT_BITS

    def layout(self) -> list[tuple[str, int]]:
        """Features that fit in the code, most significant first, with their widths.

        A feature that does not fit is skipped and the next one is tried.
        """
        out, used = [], 0
        for feature in self.spec.priority:
            width = self.bits(feature)
            if used + width <= self.spec.code_bits:
                out.append((feature, width))
                used += width
        return out

    def with_bins(self, features: DataFrame, names: list[str] | None = None, suffix: str = "_bin") -> DataFrame:
        """Add the bin number of each feature as ``<feature>_bin``."""
        names = names or [n for n in self.spec.priority if n in features.columns]
        numeric = [n for n in names if n in self.bins and self.bins[n].thresholds is not None]
        out = features
        if numeric:
            out = self._search(out, numeric)
        binned = []
        for n in names:
            if n in numeric:
                # Bucket k of the mirrored value means m - k distinct thresholds lie below.
                below = F.get(_constant_ints(self._slots(n)), F.col(f"__slot_{n}").cast("int"))
                binned.append(below.cast("bigint").alias(f"{n}{suffix}"))
            elif n in self.bins:
                binned.append(_category_bin(F.col(n).cast("double"), self.bins[n]).alias(f"{n}{suffix}"))
            else:
                binned.append(F.lit(0).cast("bigint").alias(f"{n}{suffix}"))
        return out.select(*features.columns, *binned)

    def _distinct(self, feature: str) -> list[float]:
        return sorted(set(0.0 + t for t in self.bins[feature].thresholds))

    def _slots(self, feature: str) -> list[int]:
        """Bin number for each bucket of the mirrored search, NaN bucket last."""
        params = self.bins[feature]
        distinct, last = self._distinct(feature), len(params.thresholds) - 1
        below, total = [0], 0
        for t in distinct:
            total += params.thresholds.count(t)
            below.append(min(total, last))
        return below[::-1] + [last]

    def _search(self, df: DataFrame, numeric: list[str]) -> DataFrame:
        """Binary search in the thresholds by the JVM-side ``Bucketizer``.

        Its buckets are closed on the left, and the bins need the number of
        thresholds strictly below the value; so value and thresholds are mirrored.
        """
        mirrored = df.select("*", *[
            (F.lit(0.0) - _search_value(F.col(n).cast("double"), self.bins[n])).alias(f"__neg_{n}") for n in numeric
        ])
        inf = float("inf")
        splits = [[-inf] + [0.0 - t for t in reversed(self._distinct(n))] + [inf] for n in numeric]
        bucketizer = Bucketizer(
            splitsArray=splits,
            inputCols=[f"__neg_{n}" for n in numeric],
            outputCols=[f"__slot_{n}" for n in numeric],
            handleInvalid="keep",
        )
        return bucketizer.transform(mirrored)

    def encode(self, features: DataFrame, col: str = "embedding", keep: tuple[str, ...] = ("id",)) -> DataFrame:
        """Packed code of each row; most significant bits hold the first feature."""
        layout = [(n, w) for n, w in self.layout() if n in features.columns]
        binned = self.with_bins(features, [n for n, _ in layout])
        code = F.lit(0).cast("bigint")
        for name, width in layout:
            code = F.shiftleft(code, width).bitwiseOR(F.col(f"{name}_bin"))
        return binned.select(*keep, code.alias(col))

    def params(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([asdict(b) for b in self.bins.values()], PARAMS)

    def save(self, spark: SparkSession, path: str) -> None:
        """Parameters as Parquet, one row per feature, with the rule set's name."""
        name = "v1" if self.spec.drop_zeros else "v2"
        extra = json.dumps({"spec": name, "priority": list(self.spec.priority)})
        self.params(spark).withColumn("spec", F.lit(extra)).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "QuantizerModel":
        rows = spark.read.parquet(path).collect()
        extra = json.loads(rows[0]["spec"])
        spec = QUANTIZER_V1 if extra["spec"] == "v1" else QUANTIZER_V2
        for feature in spec.priority:
            if feature not in extra["priority"]:
                spec = spec.without(feature)
        return cls.from_rows(spec, rows)


def _log(value: Column) -> Column:
    """log10(v + 1): NaN for a negative argument and -inf for 0, where Spark gives null."""
    return F.when(value >= -1, F.coalesce(F.log10(value + 1), F.lit(float("-inf")))).otherwise(F.lit(float("nan")))


def _search_value(value: Column, params: FeatureBins) -> Column:
    """The value on the scale of the thresholds; NaN stays NaN."""
    if params.type == "log_continuous":
        return _log(value)
    if params.min_val is not None:
        clipped = F.least(F.greatest(value, F.lit(params.min_val)), F.lit(params.max_val))
        return F.when(F.isnan(value), value).otherwise(clipped)
    return value


def _category_bin(value: Column, params: FeatureBins) -> Column:
    """Index among the sorted categories, unseen as 0."""
    known = params.categories
    zero = F.lit(0).cast("bigint")
    if list(known) == [float(i + 1) for i in range(len(known))]:
        return F.when(value.between(1.0, float(len(known))), (value - 1).cast("bigint")).otherwise(zero)
    listed = F.expr(f"cast(split('{','.join(repr(c) for c in known)}', ',') as array<double>)")
    return F.coalesce(F.greatest(F.array_position(listed, value) - 1, F.lit(0)).cast("bigint"), zero)


def _constant_ints(values: list[int]) -> Column:
    """A literal array; one string to parse instead of a call per element."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<int>)")


def fit_quantizer(features: DataFrame, spec: QuantizerSpec = QUANTIZER_V2) -> QuantizerModel:
    """Learn the bins of one training table."""
    return QuantizerModel.from_rows(spec, fit_bins(features, spec))


def encode_runs(
    features: DataFrame, models: dict[int, QuantizerModel], keep: tuple[str, ...] = ("run", "id")
) -> DataFrame:
    """Codes of rows that belong to different models (``run``), in one plan.

    Bins and layout of each run come from a broadcast table with a row per run.
    """
    names = next(iter(models.values())).spec.priority
    fields, rows = ["run int"], []
    for n in names:
        fields += [f"w_{n} int", f"t_{n} array<double>", f"c_{n} array<double>", f"l_{n} double", f"h_{n} double", f"log_{n} boolean"]
    for run, model in models.items():
        widths, row = dict(model.layout()), [run]
        for n in names:
            b = model.bins.get(n)
            row += [widths.get(n, 0), b and b.thresholds, b and b.categories, b and b.min_val, b and b.max_val,
                    bool(b) and b.type == "log_continuous"]
        rows.append(tuple(row))
    table = features.sparkSession.createDataFrame(rows, ", ".join(fields))
    joined = features.join(F.broadcast(table), "run")
    code, zero = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for n in names:
        value, steps, known = F.col(n).cast("double"), F.col(f"t_{n}"), F.col(f"c_{n}")
        moved = F.when(F.col(f"log_{n}"), _log(value)).when(F.isnan(value), value).otherwise(
            F.least(F.greatest(value, F.col(f"l_{n}")), F.col(f"h_{n}"))
        )
        last = F.size(steps) - 1
        slot = F.when(F.isnan(moved), last).otherwise(F.least(left_search(steps, moved, 1024), last)).cast("bigint")
        category = F.coalesce(F.greatest(F.array_position(known, value) - 1, F.lit(0)).cast("bigint"), zero)
        bin_ = F.when(F.col(f"w_{n}") == 0, zero).when(steps.isNotNull(), slot).when(known.isNotNull(), category).otherwise(zero)
        code = F.call_function("shiftleft", code, F.col(f"w_{n}")).bitwiseOR(bin_)
    return joined.select(*keep, code.alias("embedding"))


def quantizer_report(params: DataFrame) -> DataFrame:
    """Of every fitted feature: class, bits and number of levels."""
    levels = F.when(F.col("type") == "categorical", F.size("categories")).otherwise(F.size("thresholds"))
    return params.select(
        "feature",
        F.when(F.col("type") == "categorical", "categorical").otherwise("continuous").alias("kind"),
        "bits",
        levels.cast("int").alias("levels"),
    )


def top_bits(params: DataFrame, n: int = 10) -> DataFrame:
    """The n features with the widest bins."""
    return quantizer_report(params).orderBy(F.desc("bits"), "feature").limit(n)
