"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next.

1. toxicity: documents that the class-conditional models reject go; the others stay
   as they are (also those with null or empty texts).
2. near_duplicates: of every group of documents that share 80% of their shingles of
   five words one stays, that with the smallest id (a row whose id another text has too
   gives way to one with an id of its own); of rows with the same id and equal texts one
   stays. Documents without words and rows without id all stay.
3. mix_sources: the documents in the proportions of the mix, a row for each time that
   one is taken, its text cut to the words taken.
4. packing: token windows of several lengths; one row per piece of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.llm.mixing import mixed_documents
from flowsift.llm.neardup import near_duplicates
from flowsift.llm.packing import pack_documents
from flowsift.llm.scratch import written
from flowsift.llm.toxicity import fit_toxicity, toxicity_scores


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = "__toxicity"
    while score in docs.columns:
        score += "_"
    return toxicity_scores(docs, model, score).where(F.col(score) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows travel as one column, so that names can't clash. Ids held by several rows are told apart by text."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("key"), F.sha2("text", 256).alias("hash"))
    again = written(rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "near-again")
    if not again.isEmpty():
        # Such rows get keys above all ids, equal ones the same; the written table keeps them if a task is run again.
        top = rows.agg(F.max("key")).first()[0]
        clashing = rows.join(again, "key", "left_semi").groupBy("key", "hash").agg(F.count("*").alias("n"))
        new = written(clashing.select(F.col("key").alias("old"), F.col("hash").alias("text_hash"), (F.monotonically_increasing_id() + top + 1).alias("new")), "near-keys")
        same = (F.col("key") == F.col("old")) & F.col("hash").eqNullSafe(F.col("text_hash"))
        rows = rows.join(new, same, "left").select("row", F.coalesce("new", "key").alias("key"), "hash")
        rows = rows.where("key is null").unionByName(rows.where("key is not null").dropDuplicates(["key"]))
        rows = written(rows, "near-rows")
    groups = near_duplicates(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")))
    gone = written(groups.where("not kept").select(F.col("doc_id").alias("key")).distinct(), "near-gone")
    return rows.join(gone, "key", "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mix_sources", mix_sources), ("packing", pack)]

ORACLE_SQL = None  # scores and token ids have no SQL form; the stages are tested one by one against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
