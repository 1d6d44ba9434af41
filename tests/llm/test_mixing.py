"""Source mixing: apportionment against one seat at a time, targets, and the words taken."""

import random

from pyspark.sql import functions as F

from flowsift.llm import mixing


def seat_by_seat(weights, seats, caps):
    given = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if given[i] < caps[i] and weights[i] > 0]
        if not open_:
            break
        given[max(open_, key=lambda i: (weights[i] / (2 * given[i] + 1), -i))] += 1
    return given


def test_apportionment():
    draw = random.Random(1)
    for _ in range(40):
        n = draw.randint(1, 8)
        weights = [draw.choice([0.0, 1.0, 2.0, 5.0, draw.random() * 9]) for _ in range(n)]
        caps = [draw.randint(0, 60) for _ in range(n)]
        seats = draw.randint(0, 120)
        assert mixing.sainte_lague(weights, seats, caps) == seat_by_seat(weights, seats, caps)
    assert mixing.sainte_lague([], 5, []) == []


def test_targets():
    assert mixing.fill_targets([10, 10, 10], [5, 2, 1], 45, 2) == [20, 50 / 3, 25 / 3]
    assert sum(mixing.fill_targets([1, 100, 100], [5, 2, 1], 300, 2)) == 300
    assert mixing.fill_targets([], [], 0, 2) == []


ROWS = [
    (None, None, "a b c"), (1, "x", None), (2, "x", ""), (3, "x", "one"), (3, "x", "one"), (4, "y", "w " * 3000),
    (5, "y", "\t lead  and\x0btail \n"), *[(i, "abcx"[i % 4], " ".join(f"w{j}" for j in range(i % 90))) for i in range(10, 400)],
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn("size", F.lit(7)).withColumn("quota", F.lit("mine"))


def test_mix(spark):
    docs = frame(spark, ROWS)
    mixed = mixing.mix_sources(docs, shard_docs=30).cache()
    rows = mixed.collect()
    assert len(rows) == len(ROWS)
    sizes = {(r.doc.doc_id, r.doc.text): r.size for r in rows}
    assert sizes[(5, "\t lead  and\x0btail \n")] == 3 and sizes[(1, None)] == 0
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        t = by.setdefault(r.doc.source, [0, 0, r.target, r.source_size])
        t[0] += r.taken
        t[1] += r.size
    for taken, size, target, source_size in by.values():
        assert size == source_size and target <= 2 * size + 1e-6
        assert abs(taken - target) <= 0.05 * target + 80
    again = {(r.doc.doc_id, r.doc.text): r.taken for r in mixing.mix_sources(docs.repartition(7), shard_docs=30).collect()}
    assert again == {(r.doc.doc_id, r.doc.text): r.taken for r in rows}
    texts = mixing.mixed_documents(docs, shard_docs=30)
    assert texts.columns == docs.columns
    words = {}
    for r in texts.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len([w for w in r.text.replace("\x0b", " ").split(" ") if w.strip()])
        assert r.size == 7 and r.quota == "mine" and r.n_chars == len(r.text)
    taken = {}
    for r in rows:
        taken[r.doc.doc_id] = taken.get(r.doc.doc_id, 0) + r.taken
    assert words == {k: v for k, v in taken.items() if v}
    mixed.unpersist()


def test_empty(spark):
    assert mixing.mix_sources(frame(spark, [])).collect() == []
    assert [r.taken for r in mixing.mix_sources(frame(spark, [(1, None, None)])).collect()] == [0]


def test_rows_without_or_with_one_id(spark):
    """A source whose rows share an id, or have none, is dealt into shards like others and meets its target."""
    rows = [(None if i % 2 else 7, "one", " ".join(f"w{i}x{j}" for j in range(20))) for i in range(600)] + [(i, "two", "a b c d") for i in range(600)]
    runs = []
    for parts in (3, 8):
        got = mixing.mix_sources(frame(spark, rows).repartition(parts), shard_docs=30).collect()
        runs.append(sorted((r.doc.text, r.taken) for r in got))
        for source in ("one", "two"):
            own = [r for r in got if r.doc.source == source]
            assert len(own) == 600
            assert abs(sum(r.taken for r in own) - own[0].target) <= 0.05 * own[0].target + 80
    assert runs[0] == runs[1]
