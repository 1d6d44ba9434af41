"""Fit and score a complete flow detector."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.functions.held import hold
from flowsift.operators.features import Vocabularies, flow_features
from flowsift.operators.lsh import LshModel, fit_lsh, knn
from flowsift.operators.quantizer import QuantizerModel, fit_quantizer
from flowsift.operators.verdict import settled, with_verdict
from flowsift.schema import (
    LSH_MODEL, LSH_MODEL_V1, LSH_V1, LSH_V2, QUANTIZER_V1, QUANTIZER_V2,
    LshSpec, QuantizerSpec,
)

# Verdict rows (a code and four numbers) that may be broadcast to the flows.
BROADCAST_VERDICTS = 1_000_000
# A code with at least this share of all flows is spread over tasks in the join back.
HOT_SHARE = 1_000
HOT_SPREAD = 64


@dataclass
class FlowCoder:
    """Vocabularies and bins: all that the features and codes of a flow need."""

    vocabularies: Vocabularies
    quantizer: QuantizerModel

    def release(self) -> None:
        """Drop the tables that fitting left in the cache; the model still works, but computes them anew."""
        self.vocabularies.release()

    def features(self, flows: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
        return flow_features(flows, self.vocabularies, optimized=self.vocabularies.state is None, keep=keep)

    def codes(self, flows: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
        return self.quantizer.encode(self.features(flows, keep), keep=keep).withColumn("run", F.lit(0))


@dataclass
class FlowDetector(FlowCoder):
    """Vocabularies, bins and index of one trained detector."""

    lsh: LshModel
    seed: int

    def release(self) -> None:
        super().release()
        self.lsh.release()

    @property
    def model_name(self) -> str:
        return LSH_MODEL_V1 if self.lsh.spec.version == "v1" else LSH_MODEL

    def score(self, flows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """``(id, keep..., model, is_anomaly, score)`` for every flow.

        Codes are scored once each and joined back to the flows.
        """
        # Kept columns travel in a struct: some share their name with a feature.
        packed = flows.withColumn("__kept", F.struct(*[F.col(c) for c in keep])) if keep else flows
        coded = self.codes(packed, ("id", "__kept") if keep else ("id",))
        counted = hold(coded.groupBy("run", "embedding").agg(F.count("*").alias("n_flows")))
        size = counted.agg(F.count("*").alias("codes"), F.sum("n_flows").alias("flows")).first()
        summary = knn(self.lsh, counted, settled(self.lsh.spec))
        if size["codes"] <= BROADCAST_VERDICTS:
            joined = coded.join(F.broadcast(summary), ["run", "embedding"])
        else:
            joined = self._join_spread(coded, summary, counted, size["flows"])
        scored = with_verdict(joined, self.lsh, self.seed, "id")
        kept = [F.col("__kept")[c].alias(c) for c in keep]
        return scored.select("id", *kept, F.lit(self.model_name).alias("model"), "is_anomaly", "score")

    def _join_spread(self, coded: DataFrame, summary: DataFrame, counted: DataFrame, flows: int) -> DataFrame:
        """Shuffle join with the flows of hot codes spread over ``HOT_SPREAD`` groups.

        At most ``HOT_SHARE`` codes can be hot, so their list is broadcast.
        """
        hot = F.broadcast(
            counted.where(F.col("n_flows") >= max(1, flows // HOT_SHARE)).select("run", "embedding", F.lit(True).alias("hot"))
        )
        spread = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(HOT_SPREAD))).otherwise(0).cast("int")
        left = coded.join(hot, ["run", "embedding"], "left").withColumn("spread", spread).drop("hot")
        copies = F.sequence(F.lit(0), F.when(F.col("hot"), HOT_SPREAD - 1).otherwise(0))
        right = summary.join(hot, ["run", "embedding"], "left").withColumn("spread", F.explode(copies)).drop("hot")
        return left.join(right, ["run", "embedding", "spread"]).drop("spread")

    def save(self, path: str) -> None:
        """Everything as Parquet under one folder."""
        spark = self.lsh.spark
        self.quantizer.save(spark, f"{path}/quantizer")
        self.lsh.save(f"{path}/lsh")
        self.vocabularies.service.write.mode("overwrite").parquet(f"{path}/service")
        if self.vocabularies.state is not None:
            self.vocabularies.state.write.mode("overwrite").parquet(f"{path}/state")
        spark.createDataFrame([(self.seed,)], "seed int").coalesce(1).write.mode("overwrite").parquet(f"{path}/seed")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FlowDetector":
        lsh = LshModel.load(spark, f"{path}/lsh")
        service = spark.read.parquet(f"{path}/service")
        state = spark.read.parquet(f"{path}/state") if lsh.spec.version == "v1" else None
        seed = spark.read.parquet(f"{path}/seed").first()["seed"]
        return cls(Vocabularies(service, state).freeze(), QuantizerModel.load(spark, f"{path}/quantizer"), lsh, seed)


def fit_flow_coder(normal: DataFrame, spec: QuantizerSpec = QUANTIZER_V2, optimized: bool = True) -> FlowCoder:
    """Learn vocabularies and bins from normal flows, without an index."""
    vocabularies = Vocabularies.learn(normal, with_state=not optimized).freeze()
    return FlowCoder(vocabularies, fit_quantizer(flow_features(normal, vocabularies, optimized=optimized), spec))


def fit_flow_detector(
    normal: DataFrame,
    seed: int = 42,
    quantizer_spec: QuantizerSpec = QUANTIZER_V2,
    lsh_spec: LshSpec = LSH_V2,
    coder: FlowCoder | None = None,
) -> FlowDetector:
    """Learn vocabularies, bins and index from normal flows; a fitted ``coder`` is taken as it is."""
    coder = coder or fit_flow_coder(normal, quantizer_spec, lsh_spec.version == "v2")
    lsh = fit_lsh(coder.codes(normal), seed, lsh_spec)
    return FlowDetector(coder.vocabularies, coder.quantizer, lsh, seed)


def fit_flow_detector_v1(normal: DataFrame, seed: int = 42, coder: FlowCoder | None = None) -> FlowDetector:
    return fit_flow_detector(normal, seed, QUANTIZER_V1, LSH_V1, coder)
