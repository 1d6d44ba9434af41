"""Near-duplicates, toxicity and language-model scoring against brute force and planted cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowsift.llm import components, contextmix, neardup, toxicity
from flowsift.llm.words import Words

UPPER = {i: i + 32 for i in range(65, 91)}
DRAW = random.Random(5)
LEXICON = ["".join(DRAW.choice(["ba", "ko", "ti", "re", "lu", "ön"]) for _ in range(DRAW.randint(1, 4))) for _ in range(400)]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def sentence(n, draw=DRAW):
    return [draw.choice(LEXICON) for _ in range(n)]


def frame(spark, rows, more="extra string, n int, comp long, row long"):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], f"doc_id long, text string, {more}")


def corpus():
    """Copies, a star of edited copies round one text, short and odd texts."""
    base = sentence(80)
    rows = [(i, " ".join(sentence(DRAW.randint(5, 60)))) for i in range(100, 220)]
    for i in range(220, 300):
        words = list(base)
        for j in DRAW.sample(range(80), DRAW.randint(0, 9)):
            words[j] = DRAW.choice(LEXICON)
        rows.append((i, " ".join(words)))
    rows += [(i, " ".join(base).upper()) for i in range(300, 330)]
    return rows + [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One "), (6, "x" * 3000), (7, "a a a a a"), (8, "a a"), (None, "lost id"), (9, " ".join(sentence(20_000)))]


def grams(text, size):
    w = split(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_groups(rows, size):
    sets = [(d, grams(t, size)) for d, t in rows if d is not None]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if s and t and 100 * both >= 80 * (len(s) + len(t) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets}


@pytest.mark.parametrize(("size", "limits"), [(2, {}), (5, {}), (2, {"BLOCK": 1500, "DENSE": 5})])
def test_near_duplicates(spark, monkeypatch, size, limits):
    for name, value in limits.items():
        monkeypatch.setattr(neardup, name, value)
    rows = corpus()
    got = neardup.near_duplicates(frame(spark, rows), size=size).collect()
    assert len(got) == len(rows)
    expected = brute_groups(rows, size)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("dense", [1, 200, 2048])
def test_near_duplicates_in_dense_regions(spark, monkeypatch, dense):
    """Pairs with similarity exactly 0.8 (8 words of 9 in common) are linked, however few classes make a region dense."""
    monkeypatch.setattr(neardup, "DENSE", dense)
    rows = []
    for i in range(2000):
        same = [f"w{i}x{k}" for k in range(8)]
        rows += [(2 * i, " ".join([*same, f"l{i}"])), (2 * i + 1, " ".join([*same, f"r{i}"]))]
    got = neardup.near_duplicates(frame(spark, rows), size=1).collect()
    assert [r.doc_id for r in got if r.component_id != r.doc_id // 2 * 2] == []


@pytest.mark.parametrize("dense", [1, 5])
def test_near_duplicates_among_texts_that_share_much(spark, monkeypatch, dense):
    """Unrelated texts (0.44 in common) fill the regions of the first levels; no pair at 0.8 is lost."""
    monkeypatch.setattr(neardup, "DENSE", dense)
    common = [f"c{k}" for k in range(55)]
    rows = []
    for i in range(250):
        same = [*common, *(f"w{i}x{k}" for k in range(25))]
        rows += [(2 * i, " ".join([*same, *(f"l{i}x{k}" for k in range(10))])), (2 * i + 1, " ".join([*same, *(f"r{i}x{k}" for k in range(10))]))]
    got = neardup.near_duplicates(frame(spark, rows), size=1).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i // 2 * 2) for i in range(500)]


def test_chance_to_meet():
    """At similarity 0.8 a pair shares a region of each level, and its sketches pass."""
    for trees, base, deep in neardup.LEVELS:
        assert deep > base and (1 - 0.8**base) ** trees < 3e-6
    least = int(neardup._least(0.8))
    assert sum(math.comb(neardup.SKETCH, k) * 0.8**k * 0.2 ** (neardup.SKETCH - k) for k in range(least)) < 4e-6


def test_sketches_in_blocks():
    """Connected sketches as by comparing all pairs, for many and few of them."""
    rng = np.random.default_rng(3)
    for m, least in ((40, 30), (1500, 40)):
        sketch = rng.integers(0, 256, (m // 5, 48), dtype=np.uint8)[rng.integers(0, m // 5, m)]
        sketch = np.where(rng.random(sketch.shape) < 0.1, rng.integers(0, 256, sketch.shape), sketch).astype(np.uint8)
        label = np.arange(m)
        for i in range(m):
            for j in np.flatnonzero((sketch[:i] == sketch[i]).sum(1) >= least):
                label[label == max(label[i], label[j])] = min(label[i], label[j])
        assert (neardup._linked(sketch, least) == label).all()


def test_near_duplicates_empty(spark):
    assert neardup.near_duplicates(frame(spark, [])).collect() == []
    got = neardup.near_duplicates(frame(spark, [(1, None), (2, None)])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (2, 2, True)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (7, 7)] + [(200, i) for i in range(201, 260)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {100: 50, 70: 50} | {i: 200 for i in range(201, 260)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_words():
    texts = ["Ab c\tab", None, "", " x\x0by ", "ab", "é É Z" * 30]
    words = Words(pa.array(texts))
    hashes, at = words.hashes(), words.doc_at
    assert [int(n) for n in np.diff(at)] == [len(split(t)) for t in texts]
    flat = [w for t in texts for w in split(t)]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


def test_toxicity(spark):
    draw = random.Random(8)
    bad = [f"grub{i}" for i in range(8)]
    rows, labels = [], []
    for i in range(900):
        words = sentence(draw.randint(20, 120), draw)
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(draw.randrange(len(words)), draw.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic) if i % 3 else int(toxic)))
    labels += [(None, 1), (3, None), (5, 0), (5, 0)]
    rows += [(5000, None), (5001, ""), (None, "no id"), (5002, "w " * 50_000)]
    docs = frame(spark, rows, "toxicity string, n int, held int, label long")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, table)
    scored = toxicity.toxicity_scores(docs, model, "score").collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert {r.toxicity for r in scored} == {"x"}
    held = [r for r in scored if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 6 == 0) for r in held]) > 0.95
    assert len({r.score for r in scored if not r.text}) == 1
    again = toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, table), "score").collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in scored}


def test_toxicity_of_a_sample(spark):
    """A sample of the larger class leaves the natural share of toxic texts in the scores."""
    draw = random.Random(12)
    rows, labels = [], []
    for i in range(4000):
        words = sentence(draw.randint(10, 30), draw)
        toxic = int(i % 8 == 0)
        if draw.random() < (0.6 if toxic else 0.1):
            words.append("grub")
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs, table = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole, some = (toxicity.fit_toxicity(docs, table, max_rows=n) for n in (20_000, 400))
    assert abs(whole.weights[0] - some.weights[0]) < 0.8
    texts = pa.array([t for _, t in rows] + ["", None])
    a, b = whole.scores(texts), some.scores(texts)
    assert np.mean((a >= 0.5) == (b >= 0.5)) > 0.97 and max(a[-1], b[-1]) < 0.2


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    for labels in ([], [(1, 0)], [(1, 1)]):
        model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert model is None
        assert [r.toxicity for r in toxicity.toxicity_scores(docs, model).collect()] == [0.0, 0.0]


def test_language_model(spark):
    draw = random.Random(4)
    after = {w: draw.choice(LEXICON[:60]) for w in LEXICON}

    def words(n):
        word = LEXICON[0]
        for _ in range(n):
            word = after[word] if draw.random() < 0.6 else draw.choice(LEXICON[:60])
            yield word if draw.random() < 0.97 else f"rare{draw.randrange(400)}"

    rows = [(i, " ".join(words(draw.randint(1, 90)))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (None, "no id"), (7, "again seven"), (1002, "Über " * 3000)]
    got = contextmix.score_texts(frame(spark, rows)).collect()
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    tokens = [(d, [*split(t), "\0end"]) for d, t in rows]
    counts = Counter(w for d, ws in tokens for w in ws if not held(d))
    n, kinds = sum(counts.values()), len(counts)
    floor = math.log10(n + 0.1 * (kinds + 1))
    expected = sorted(
        (d is None, d or 0, held(d), len(ws), sum(w in counts for w in ws), round(sum(math.log10(counts[w] + 0.1) - floor for w in ws), 5)) for d, ws in tokens
    )
    assert expected == sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got)
    assert all(r.train_tokens == n and r.bits > 0 for r in got)
    fresh = [r for r in got if r.held_out]
    assert sum(r.bits for r in fresh) * math.log10(2) < -sum(r.base_score for r in fresh)


def test_language_model_is_a_distribution():
    """The probabilities of all symbols of a tree sum to one in any context."""
    code = contextmix.Code(np.array([50, 3, 1, 1, 0, 20]))
    mixer = contextmix.Mixer((8, 8, 8))
    rng = np.random.default_rng(1)
    contexts = [rng.integers(0, 9, 500).astype(np.uint64) for _ in range(3)]
    contextmix._learn(mixer, code, rng.integers(0, 6, 500), contexts)
    for c in range(5):
        same = [np.full(6, c, np.uint64)] * 3
        assert abs((2.0 ** contextmix._log2(mixer, code, np.arange(6), same)).sum() - 1) < 1e-4


def test_mixer_learns_from_every_decision():
    """In a large block all decisions move the weights and enter the refining table."""
    n = 60_000
    rng = np.random.default_rng(2)
    contexts, of = [rng.integers(0, 9, 50).astype(np.uint64) for _ in range(3)], rng.integers(0, 50, n)
    mixer = contextmix.Mixer((8, 8, 8))
    mixer.learn(contexts, of, np.zeros(n, np.uint64), np.zeros(n, np.int32), (rng.random(n) < 0.8).astype(np.int8))
    assert mixer.refine.sum() == mixer.seen == n


def test_spelling_is_learned_from_escaped_words():
    """Decisions of the spelling mixer: all escaped words, as often as they occur, and no others."""
    counts = np.array([5, 1, 9])
    name = Words(pa.array(["known"])).hashes()
    vocabulary = contextmix.Vocabulary(name, np.array([0]), counts, np.ones(257, np.int64))
    batch = pa.record_batch({"doc_id": pa.array([1, 2]), "text": pa.array(["known rare rare known", "rare known"])})
    tails = [r for out in contextmix._train(vocabulary)(iter([batch])) for r in out.to_pylist() if r["p"] < 0 and r["level"] == 1]
    letters = np.array([*b"rare", 256])
    assert np.frombuffer(tails[0]["data"], np.float64)[0] == 3 * vocabulary.spelling.long[letters].sum()


def test_language_model_empty(spark):
    assert contextmix.score_texts(frame(spark, [])).collect() == []
    rows = contextmix.score_texts(frame(spark, [(30, "no training text")])).collect() if zlib.crc32(b"30") % 10 == 0 else []
    assert all(r.n_known == 0 for r in rows)


def test_shingles_by_slices_are_those_of_the_whole():
    texts = pa.array([" ".join(sentence(n)) if n else ([None, ""][k % 2]) for k, n in enumerate([30_000, 0, 3, 0, 90_000, 1, 7, 60_000, 0])])
    for some in (texts, texts.slice(1, 5), texts.slice(0, 0)):
        for size in (2, 5):
            want, got = neardup.shingles(some, size), neardup.shingles_by_slices(some, size)
            assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(want, got, strict=True))


@pytest.mark.parametrize("words", range(6))
def test_shingles_of_few_words(words):
    """A slice of the table may hold fewer words than a shingle."""
    sets, at = neardup.shingles(pa.array([" ".join(sentence(words)), None]), 5)
    assert len(sets) == at[-1] == (words > 0) and at.tolist() == [0, words > 0, words > 0]


def test_mixer_learns_the_same_in_stretches(monkeypatch):
    """Stretches that fit the cache change no counter, weight or refined outcome."""
    code, rng = contextmix.Code(np.array([50, 3, 1, 1, 0, 20])), np.random.RandomState(5)
    symbols = rng.randint(0, 6, 3000)
    contexts = [rng.randint(0, 9, 3000).astype(np.uint64) for _ in range(3)]
    found = []
    for stretch in (1 << 30, 7):
        monkeypatch.setattr(contextmix, "STRETCH", stretch)
        mixer = contextmix.Mixer((8, 8, 8))
        contextmix._learn(mixer, code, symbols, contexts)
        found.append([*mixer.counts, mixer.weights, mixer.refine])
    assert all((a == b).all() for a, b in zip(*found, strict=True))
    assert found[0][0].sum() == code.long[symbols].sum()


def test_tokens_with_the_same_contexts_share_a_number():
    """The number of symbol and contexts is the same only where all of them are."""
    kinds = np.array([7, 8, 9, 10], np.uint64)
    order = np.argsort(kinds)
    vocabulary = contextmix.Vocabulary(kinds[:3][order[:3]], order[:3], np.array([5, 4, 3, 2, 1]), np.ones(257, np.int64))
    rng, texts = np.random.RandomState(2), []
    for _ in range(40):
        texts.append(" ".join(rng.choice(list("abcd"), rng.randint(0, 9))))
    words = Words(pa.array(texts))
    codes, found, _ = contextmix._kinds(words)
    symbols, contexts, _, _, same = contextmix._encode(words, vocabulary, codes, kinds[: len(found)])
    tuples = list(zip(symbols.tolist(), *[c.tolist() for c in contexts], strict=True))
    assert len(set(tuples)) == len(set(same.tolist())) == len(set(zip(tuples, same.tolist(), strict=True))) < len(tuples)


def test_mixer_learns_repeated_symbols_at_once():
    """A symbol with its times is learned like its repetitions, and scored like them."""
    code, rng = contextmix.Code(np.array([50, 3, 1, 1, 0, 20])), np.random.RandomState(6)
    symbols, number = rng.randint(0, 6, 3000), rng.randint(0, 9, 3000).astype(np.uint64)
    contexts = [number, number // np.uint64(2), number // np.uint64(4)]
    same = number * np.uint64(6) + symbols.astype(np.uint64)
    found, scores = [], []
    for key in (None, same):
        mixer = contextmix.Mixer((8, 8, 8))
        contextmix._learn(mixer, code, symbols, contexts, key)
        found.append([*mixer.counts, mixer.refine, mixer.seen])
        scores.append((mixer.weights, contextmix._log2(mixer, code, symbols, contexts, key)))
    assert all(np.array_equal(a, b) for a, b in zip(*found, strict=True))
    assert all(np.allclose(a, b, rtol=1e-4) for a, b in zip(*scores, strict=True))
    assert found[1][-1] == code.long[symbols].sum()
