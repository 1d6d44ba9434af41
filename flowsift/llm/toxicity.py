"""Toxicity by class-conditional Kneser-Ney models.

Two word-bigram models, of toxic and of ordinary texts, with absolute discounts and
the Kneser-Ney way of counting contexts, not repeats: an expression counts once for
each text of the class it occurs in, and equal texts are one. Under the bigrams stand
each class's counts of single words, with backoff weights from both classes.
Expressions that are rare (fewer than ``min_count`` in both classes together), or whose
counts differ from the classes' shares by less than ``clear`` standard errors, rest on the
shared counts of both classes, so they speak for neither. A text's score is a
logistic function of the difference of the two log-likelihoods, over the whole
text, taken per word and per root of the number of words, fitted on rows held back
from the counts.

The fit uses a bounded sample of labelled rows: at most about ``max_rows`` of each
class (chosen by a hash of the id). So the tables of the
model, which all tasks get, are bounded by ``max_rows`` texts of a class. Where a
class is sampled, its rows weigh the inverse of its rate in calibration, in the class
shares and in the shared counts, so that scores stand for the natural share of
toxic texts. Scoring reads every text once, with no shuffle.

Defined results: a null text is empty; an empty text has no evidence, its score is
that of difference 0; rows with equal or null ids are scored each; labels of one
id count once (the highest); without rows of both classes all scores are 0.
Other columns of the input never take part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.scratch import ship, written
from flowsift.llm.tokens import release
from flowsift.llm.words import Words, mix64, pieces

START = np.uint64(0x51ED270B7A3C5F19)
DISCOUNT = 0.75


def fold(doc_id: str = "doc_id", folds: int = 5):
    """Remainder of the crc32 of the id as text."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def _expressions(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word, the word before it in its text, and the pair."""
    word = words.hashes()
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[words.doc_at[:-1][words.doc_at[:-1] < len(word)]] = START
    return word, before, mix64(before * np.uint64(3) + word)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of words (before: null) and pairs: in how many texts of each class they occur."""
    for batch in batches:
        for part in pieces(batch, "text", 1 << 18):
            words = Words(part.column("text"))
            words.trim()
            word, before, pair = _expressions(words)
            label = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            doc = words.doc_of()
            for key in (pair, word):
                seen = pd.DataFrame({"key": key, "doc": doc, "word": word, "before": before}).drop_duplicates(["key", "doc"])
                seen["toxic"] = label[seen["doc"].to_numpy()]
                sums = seen.groupby("key", sort=False).agg(
                    word=("word", "first"), before=("before", "first"), toxic=("toxic", "sum"), n=("toxic", "size")
                )
                i64 = lambda x: pa.array(np.asarray(x, np.uint64).view(np.int64))
                yield pa.record_batch({
                    "key": i64(sums.index), "word": i64(sums["word"]),
                    "before": i64(sums["before"]) if key is pair else pa.nulls(len(sums), pa.int64()),
                    "toxic": pa.array(sums["toxic"].to_numpy(np.int64)), "ordinary": pa.array((sums["n"] - sums["toxic"]).to_numpy(np.int64)),
                })
    release()


def _table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order].astype(np.float32)


def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, values = table
    if not len(names):
        return np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    found = names[at] == keys
    return np.where(found, values[at], np.float32(0)), found


@dataclass
class KneserNeyPair:
    """Log-ratios toxic to ordinary of the pairs and words that don't rest on shared counts."""

    pairs: tuple[np.ndarray, np.ndarray]
    words: tuple[np.ndarray, np.ndarray]
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)

    def ratios(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Difference of log-likelihoods and number of words of each text."""
        words = Words(texts)
        words.trim()
        n = np.diff(words.doc_at)
        if not len(words):
            return np.zeros(len(n)), n
        word, before, pair = _expressions(words)
        kept, is_kept = _look(self.pairs, pair)
        one, _ = _look(self.words, word)
        each = np.where(is_kept, kept, one).astype(np.float64)
        return np.bincount(words.doc_of(), weights=each, minlength=len(n)), n

    def scores(self, texts: pa.Array) -> np.ndarray:
        total, n = self.ratios(texts)
        z = _features(total, n) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _features(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    n = np.maximum(n, 1)
    return np.stack([np.ones(len(n)), 20 * total / n, total / np.sqrt(n)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Newton steps with a small ridge; each row counts ``weight`` times."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 0.1 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        w = w + np.linalg.solve(hess, grad)
    return w


def _log_ratio(toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    return np.log(toxic) - np.log(ordinary)


def _model(pairs: pd.DataFrame, words: pd.DataFrame, befores: pd.DataFrame, total: dict, weigh: dict) -> KneserNeyPair:
    """Ratios of the expressions that keep class counts.

    pairs: counts by class; words: counts of the kept words and of both words of kept
    pairs (own: kept); befores: number of kinds of pairs that begin with a word;
    weigh: labelled rows for each sampled row of a class.
    """
    words, befores = words.set_index("word"), befores.set_index("before")
    low, high = {}, {}
    left, right = words.reindex(pairs["before"]), words.reindex(pairs["word"])
    both = (left["toxic"] + left["ordinary"]).fillna(0).to_numpy(float)
    weight = np.minimum(1, DISCOUNT * befores["kinds"].reindex(pairs["before"]).fillna(1).to_numpy(float) / np.maximum(both, 1))
    for c in ("toxic", "ordinary"):
        n = max(total[c], 1)
        floor = max(DISCOUNT * total[f"{c}_words"], 1) / n / max(total["words"], 1)
        share = total[c] / max(sum(weigh[d] * total[d] for d in weigh), 1)  # of the natural counts, in the sample
        lower = lambda count: np.maximum(count - DISCOUNT, 0) / n + floor  # noqa: B023, E731
        low[c] = lower(words[c].to_numpy(float))
        shared = sum(weigh[d] * right[d] for d in weigh).to_numpy(float) * share
        below = lower(np.where(right["own"].to_numpy(bool), right[c].to_numpy(float), shared))
        high[c] = np.maximum(pairs[c].to_numpy(float) - DISCOUNT, 0) / np.maximum(left[c].fillna(0).to_numpy(float), 1) + weight * below
    u64 = lambda s: s.to_numpy(np.int64).view(np.uint64)
    own = words["own"].to_numpy(bool)
    return KneserNeyPair(
        _table(u64(pairs["key"]), _log_ratio(high["toxic"], high["ordinary"])),
        _table(u64(words.index.to_series())[own], _log_ratio(low["toxic"], low["ordinary"])[own]),
    )


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, min_count: int = 3, clear: float = 5.0, folds: int = 5, test_fold: int = 0
) -> KneserNeyPair | None:
    """The model from labelled texts outside the test fold; None without both classes."""
    spark = docs.sparkSession
    ship(spark)
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(folds=folds) != test_fold))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    draw = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, max_rows / sizes[1]).otherwise(max_rows / sizes[0])
    chosen = known.where(draw < share)  # about 2 * max_rows ids
    drawn = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    weigh = {name: sizes[c] / max(drawn.get(c, 0), 1) for c, name in ((1, "toxic"), (0, "ordinary"))}
    rows = written(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
        .withColumn("held", F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(4)) == 0),
        "toxic-sample",
    )
    counted = written(
        rows.where("not held").groupBy(F.xxhash64("text").alias("same"), "toxic").agg(F.first("text").alias("text"))
        .select("text", "toxic")
        .mapInArrow(_count, "key long, word long, before long, toxic long, ordinary long")
        .groupBy("key", "word", "before").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")),
        "toxic-counts",
    )
    by_word, by_pair = counted.where("before is null"), counted.where("before is not null")
    total = {k: v or 0 for k, v in by_word.agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), F.count("*").alias("words"),
        F.count_if(F.col("toxic") > 0).alias("toxic_words"), F.count_if(F.col("ordinary") > 0).alias("ordinary_words"),
    ).first().asDict().items()}
    natural = {c: weigh[c] * total[c] for c in weigh}
    share = natural["toxic"] / max(sum(natural.values()), 1)
    both = weigh["toxic"] * F.col("toxic") + weigh["ordinary"] * F.col("ordinary")
    # A sampled count varies more than a full one: by its class's weight.
    spread = (1 - share) * weigh["toxic"] + share * weigh["ordinary"]
    away = F.abs(weigh["toxic"] * F.col("toxic") - both * share)
    own = (F.col("toxic") + F.col("ordinary") >= min_count) & (away >= clear * F.sqrt(both * share * (1 - share) * spread))
    pairs = by_pair.where(own).toPandas()
    parts = pd.concat([pairs["word"], pairs["before"]]).astype("int64").drop_duplicates().to_frame("word")
    parts = F.broadcast(spark.createDataFrame(parts, "word long"))
    words = by_word.withColumn("own", own)
    words = words.where("own").unionByName(words.where("not own").join(parts, "word").select(words.columns)).toPandas()
    befores = by_pair.join(parts.withColumnRenamed("word", "before"), "before").groupBy("before").agg(F.count("*").alias("kinds")).toPandas()
    model = _model(pairs, words, befores, total, weigh)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                ratio, n = model.ratios(part.column("text"))
                yield pa.record_batch({"toxic": part.column("toxic").cast(pa.int32()), "ratio": pa.array(ratio), "n": pa.array(n.astype(np.int64))})

    seen = rows.where("held").select("text", "toxic").mapInArrow(evidence, "toxic int, ratio double, n long").toPandas()
    if seen["toxic"].nunique() == 2:
        x = _features(seen["ratio"].to_numpy(), seen["n"].to_numpy())
        toxic = seen["toxic"].to_numpy(float)
        model.weights = tuple(_logistic(x, toxic, np.where(toxic == 1, weigh["toxic"], weigh["ordinary"])))
    else:
        # Nothing to fit on: texts without evidence are as toxic as the labels say, and never rejected.
        model.weights = (min(float(np.log(sizes[1] / sizes[0])), -0.1), 1.0, 0.0)
    return model


def toxicity_scores(docs: DataFrame, model: KneserNeyPair | None, name: str = "toxicity") -> DataFrame:
    """All columns of the input, and ``name``: 0 to 1 (an own column of that name is replaced)."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != name]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    if model is None:
        return rows.withColumn(name, F.lit(0.0))
    schema = rows.withColumn(name, F.lit(0.0)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 18):
                columns = {c: part.column(c) for c in kept} | {name: pa.array(model.scores(part.column("text")))}
                yield pa.record_batch(columns)
        release()

    return rows.mapInArrow(score, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity_scores(docs, model)
    return scored.select(
        "doc_id", (fold() == 0).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
