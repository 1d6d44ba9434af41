"""Registered queries beside their SQL on the smallest folder, and the pipeline stage by stage."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check_queries import compare, duck
from conftest import SMALL
from flowsift.llm import catalog, neardup, toxicity
from flowsift.llm.scratch import written


def test_registered():
    names = set(entry.queries())
    assert set(catalog.QUERIES) <= names and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 1 + len(catalog.QUERIES)))
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_values(spark, name):
    status, _, _, note = compare(spark, duck(SMALL), SMALL, name, catalog.QUERIES[name], catalog.ORACLES[name])
    assert status == "equal", note


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, before, SMALL), f"test-{name}")
        if name == "toxicity":
            scores = toxicity.toxicity_scores(before, toxicity.fit_toxicity(before, spark.read.parquet(f"{SMALL}/labels.parquet")), "s")
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scores.where("s < 0.5").collect()}
        if name == "near_duplicates":
            groups = neardup.near_duplicates(before)
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in groups.where("kept").collect()}
        if name != "packing":
            assert after.columns == columns
        before = after
    assert before.count() > 0
    assert corpus_pipeline.run(spark, SMALL).count() == before.count()


def test_pipeline_on_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "a b c d e f", "en", None, 11), (2, "a b c d e f", "en", None, 11), (3, "a b c d e f", None, "b", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.where("false")):
        kept = corpus_pipeline.drop_near_duplicates(spark, corpus_pipeline.drop_toxic(spark, table, SMALL), SMALL)
        assert kept.columns == docs.columns
        assert kept.count() == (3 if table is docs else 0)
        packed = corpus_pipeline.pack(spark, corpus_pipeline.mix_sources(spark, kept, SMALL), SMALL)
        assert packed.where("doc_id is not null").count() >= (1 if table is docs else 0)


def test_pipeline_with_ids_held_twice(spark):
    words = "a b c d e f g h"
    rows = [(1, words, 7, 0.5), (2, words, 8, 0.5), (2, "quite other words than those above are here", 9, 0.5), (3, None, 1, 0.1), (3, None, 1, 0.1), (3, "", 1, 0.1), (4, words, 2, 0.2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long, __toxicity double")
    kept = corpus_pipeline.drop_near_duplicates(spark, corpus_pipeline.drop_toxic(spark, docs, SMALL), SMALL)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.select("doc_id", "key", "__toxicity").collect()) == [(1, 7, 0.5), (2, 9, 0.5), (3, 1, 0.1), (3, 1, 0.1)]
