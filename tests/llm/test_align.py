"""Aligned token groups against a plain version that compares all pairs of tokens of a text."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from flowsift.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The committee's colour, antidisestablishmentarianism!", "", None, "same text here", "same text here", "a  b\n\nc\td ", " lead",
    "ünïcödé déjà vu 日本語。", "<|endoftext|> and <unk> </s> <0x41>", "▁ a letter that stands for a blank", "1234567890 12,345.67",
    "x" * 300, "word " * 700, "\x00\x01", "é", "\r\n", "the the the cat", "ﬁ ligature",
]


def rows():
    return [(i % 13 if i else None, t) for i, t in enumerate(TEXTS)]


def plain(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    a_bytes, b_bytes = align.side_a(A).entries, align.side_b(B).entries
    found, holders = [], defaultdict(set)
    for k, (doc, text) in enumerate(rows):
        ids = ([], [])
        if text:
            ids = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
            want = (" " + text).encode()
            if b"".join(a_bytes[i] for i in ids[0]) != want or b"".join(b_bytes[i] for i in ids[1]) != want:
                ids = ([], [])
        spans = []
        for side, names in zip(ids, (a_bytes, b_bytes), strict=True):
            at, out = 0, []
            for i in side:
                out.append((at, at + len(names[i]), i))
                at += len(names[i])
            spans.append(out)
        links = []
        for s, e, i in spans[0]:
            links += [(i, j) for t, f, j in spans[1] if t < e and s < f]
        groups, done = [], 0
        for cut in sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}):
            groups.append("|".join(",".join(str(i) for s, e, i in side if done <= s and e <= cut) for side in spans))
            done = cut
        for link in links:
            holders[link].add(k)
        found.append((doc, spans, links, groups))
    top = Counter()
    for (i, _), docs in holders.items():
        top[i] = max(top[i], len(docs))
    out = []
    for doc, spans, links, groups in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((
            doc, len(spans[0]), len(spans[1]), len(groups), len(links), sum(len(holders[x]) == top[x[0]] for x in links),
            sum(len(holders[x]) for x in links), digest,
        ))
    return out, {(i, j, len(d), len(d) == top[i]) for (i, j), d in holders.items()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, block int, pairs binary")


@pytest.mark.parametrize("block", [1, align.BLOCK])
def test_all_pairs(spark, block):
    want, pairs = plain(rows())
    got = align.align_tokens(frame(spark, rows()).repartition(3), A, B, block)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got.documents.collect()), key=key) == sorted(want, key=key)
    assert {tuple(r) for r in got.pairs.collect()} == pairs


def test_no_rows(spark):
    got = align.align_tokens(frame(spark, rows()).where("false"), A, B)
    assert got.documents.count() == 0 and got.pairs.count() == 0
    assert [tuple(r)[1:] for r in align.align_tokens(frame(spark, [(1, None), (2, "")]), A, B).documents.collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_identity_map():
    a, b = align.side_a(A), align.side_b(B)
    same = align.identity_map(a, b)
    assert all(b.entries[j] == a.entries[i] for i, j in enumerate(same.tolist()) if j >= 0)
    assert (same >= 0).sum() > 10_000 and not b.bytewise[same[same >= 0]].all()
