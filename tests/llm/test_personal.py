"""Base spans against the patterns as they are written; trees against Spark ML; what the model adds."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SMALL
from flowsift.llm import personal

RULES = [
    (personal.EMAIL, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    (personal.IP, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    (personal.CARD, r"[0-9]([\x20-]?[0-9])+"),
    (personal.PHONE, r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain(text):
    out = []
    for kind, rule in RULES:
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            good = (
                True if kind == personal.EMAIL
                else all(int(p) <= 255 for p in m.group().split(".")) if kind == personal.IP
                else 12 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in double) % 10 == 0 if kind == personal.CARD
                else 9 <= len(digits) <= 15
            )
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


PARTS = ["@", ".", "a", "b-c", "1", "255", "256", "007", " ", "+1 (555) 123-4567", "4539578763621486", "x.y@m.org", "-", "(", "é", "10.0.0.1", "%", "\n", "0" * 30]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
def test_base_spans(text):
    assert personal.base_spans(text) == plain(text)


def test_long_runs():
    for text in ("a" * 200_000, "1" * 200_000, "a" * 100_000 + "@", "1." * 50_000, "12 " * 30_000, "@" * 50_000):
        personal.base_spans(text)
        personal.candidates(text)
    assert personal.base_spans("9" * 5000 + ".1.1.1") == []


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = "the and of in from to on re an at".split()

    def card():
        body = [rng.choice("45")] + [rng.choice("0123456789") for _ in range(14)]
        return next("".join(body) + c for c in "0123456789" if personal.luhn("".join(body) + c))

    def private():
        return rng.choice([
            f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}", card(),
            f"{rng.choice('abc')}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", ".".join(str(rng.randint(1, 255)) for _ in range(4)),
        ])

    rows = []
    for i in range(1500):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))
        if i % 2:
            text = f"{text} {private()} {' '.join(rng.choice(words) for _ in range(5))}"
        elif i % 4 == 0:
            text += f" version {rng.randint(1, 9)}.{rng.randint(0, 9)} of 20{rng.randint(10, 30)}"
        rows.append((i, text, i, "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, spans int, kind string").repartition(4).cache()


@pytest.fixture(scope="module")
def model(docs):
    return personal.fit_personal(docs, max_rows=2000)


def test_trees_are_those_of_spark(spark, docs):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = personal.labelled(docs).select("label", array_to_vector("x").alias("features")).cache()
    fitted = GBTClassifier(labelCol="label", maxIter=3, maxDepth=3, seed=1).fit(rows)
    got = fitted.transform(rows).select("features", vector_to_array("probability")[1].alias("p")).collect()
    x = np.array([r.features.toArray() for r in got])
    assert np.allclose(personal.trees_of(fitted).scores(x), [r.p for r in got], atol=1e-12)


def test_other_spellings_are_found_and_clean_texts_left(spark, model):
    assert model.trees is not None and all(t <= 1 for t in model.thresholds)
    private = {
        "ask a.17 at mail3 dot example dot com and of": "email", "re on 17[.]4[.]200[.]9 the an": "ip",
        "the in (331) 555-0188 of the": "phone", "the of 4539.5787.6362.1486 in": "card",
        "re 4539578763621486 4539578763621486 on": "card", "the +1 (331) 555-0188 4539578763621486 of": "phone",
    }
    clean = ["version 3.2 of 2019 and the", "the 4539578763621487 of", "at the end of 2024", "", "the 300[.]4[.]200[.]9 of", "12 24 36 48 60 72 84 96"]
    found = personal.spans_of([*private, *clean], model)
    hit = [any(personal.KINDS[k] == kind and not base for _, k, _, base, _ in f) for f, kind in zip(found, private.values(), strict=False)]
    assert sum(hit) >= 5, list(zip(private, hit, strict=True))
    assert not any(found[len(private) :])


def test_query_columns(spark, docs, model):
    odd = spark.createDataFrame([(None, None, 1, "x"), (7, "", 1, "x"), (7, "a@b.co", 1, "x"), (7, "a@b.co", 1, "x"), (8, "é" * 3 + " 10.0.0.1 " + "w " * 50_000, 1, "x")], docs.schema)
    got = personal.find_personal_data(odd.unionByName(docs), model, ("doc_id", "kind", "text"), "found").collect()
    assert len(got) == 1505
    for r in got:
        spans = [(s.start, personal.KINDS.index(s.kind), s.end) for s in r.found]
        assert spans == sorted(spans) and [x for x, s in zip(spans, r.found, strict=True) if s.base] == plain(r.text or "")
        for i, s in enumerate(r.found):
            assert s.base or not any(t.start < s.end and s.start < t.end for j, t in enumerate(r.found) if j != i)
    assert personal.find_personal_data(docs.where("false"), model).count() == 0


def test_no_model_without_base_spans(spark, docs):
    bare = docs.where("not text rlike '[0-9@]'")
    for table in (bare, docs.where("false")):
        empty = personal.fit_personal(table)
        assert empty.trees is None
        assert personal.find_personal_data(table, empty).where("size(spans) > 0").count() == 0


def test_redacted(spark):
    rows = spark.createDataFrame([("héy a@b.co, x", [("email", 4, 10)]), ("none", []), ("12345", [("ip", 0, 3), ("card", 1, 5)])], "text string, s array<struct<kind:string,start:int,end:int>>")
    assert [r.t for r in rows.select(personal.redacted(F.col("text"), F.col("s")).alias("t")).collect()] == ["héy <email>, x", "none", "<ip>"]


def test_op13(spark):
    got = personal.op13(spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        spans = plain(texts[r.doc_id] or "")
        named = [f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(named) <= set(r.spans.split(",")) | {""}
