"""Token ids against the tokenizer itself; token files read back; packing as a partition of all ids."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from flowsift.llm import packing, tokenfiles, tokens
from flowsift.llm.scratch import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "a\xa0  b", "x  y\n\nz's it's", "", None, "don't… stop. 12,5 ünïcode×. ÷.", " \t lead ", "a　b c.", "<|endoftext|> hi", "日本語。テスト . ok",
    "e.g. foo...bar ?!", "é.é", "a\x1cb c", "x\x85 y", "tab\tword \r\n end\n", "long " * 9000, "same text", "same text", "\n", "a\nb", "a \n b\n\n\nc",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, "x") for r in rows], "doc_id long, text string, length int, ids string")


def rows():
    return [(None, "no id"), *[(i * 7 % 23, t) for i, t in enumerate(TEXTS)], (4, "again four")]


def ids_of(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_pieces_equal_the_tokenizer(tokenizer):
    got, at = tokens.encode_with_end(pa.array(TEXTS), PATH, 5)
    for i, text in enumerate(TEXTS):
        assert got[at[i] : at[i + 1]].tolist() == ids_of(tokenizer, text, 5), text
    assert tokens.encode_with_end(pa.array([], pa.string()), PATH, 5)[0].tolist() == []


def test_added_tokens(tokenizer):
    text = "hello <|endoftext|> world"
    assert tokens.encoder(PATH).encode(pa.array([text]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    tokenizer.encode_special_tokens = True
    assert tokens.encoder(PATH, plain=True).encode(pa.array([text]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    tokenizer.encode_special_tokens = False


def test_token_files(spark, tokenizer):
    folder = new_path(spark, "test-tokens")
    files = tokenfiles.write_token_files(frame(spark, rows()), folder, PATH, length=32)
    got = sorted(tokenfiles.read_token_files(files, length=32).collect(), key=lambda r: r.start)
    at, seen = 0, []
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
        seen.append((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    assert [d for d, _ in seen] == sorted((d for d, _ in seen), key=lambda d: (d is not None, d))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(seen, key=key) == sorted(((d, ids_of(tokenizer, t, 0)) for d, t in rows()), key=key)
    for f in files.collect():
        with tokenfiles.open_source(f"{f.path}.arrow") as source:
            file = tokenfiles.TokenFile(source, 32)
            n = -(-f.n_tokens // 32)
            masks = [file.sequence(i) for i in range(n)]
            assert all(len(ids) == 32 for ids, _ in masks) and sum(m.sum() for _, m in masks) == f.n_tokens
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(frame(spark, []), new_path(spark, "test-tokens"), PATH)).collect() == []


def test_pack_unit():
    rng = np.random.default_rng(2)
    for last in (True, False):
        lengths = np.concatenate([rng.integers(1, 70, 300), [0, 1, 64, 640, 1000]])
        windows, rest = packing.pack_unit(lengths, 64, 8, last)
        seen = defaultdict(list)
        for size, parts in windows:
            total = sum(n for _, _, n in parts)
            assert total == size
            for d, s, n in parts:
                seen[d].append((s, n))
        for d, s, n in rest:
            seen[d].append((s, n))
        for d, n in enumerate(lengths):
            at = 0
            for s, m in sorted(seen[d]):
                assert s == at
                at += m
            assert at == n
        assert sum(n for _, _, n in rest) < 8 and (not last or not rest)


def test_packing(spark, tokenizer):
    docs = frame(spark, [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id")])
    got = packing.pack_documents(docs, PATH, length=64, least=8, unit_tokens=300, group_tokens=256).collect()
    expected = {i: ids_of(tokenizer, t, 1) for i, t in [*enumerate(TEXTS), (None, "no id")]}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length and r.doc_tokens == len(expected[r.doc_id])
        pieces[r.doc_id].append((r.start, ids))
        windows[r.sequence_id].append((r.offset, r.length, r.sequence_length))
    assert {d: [x for _, p in sorted(ps) for x in p] for d, ps in pieces.items()} == expected
    padding = 0
    for parts in windows.values():
        at = 0
        for offset, length, size in sorted(parts):
            assert offset == at
            at += length
        assert at <= size <= 64
        padding += size - at
    assert padding == 0  # on any number of partitions
    assert packing.pack_documents(frame(spark, []), PATH).collect() == []


def test_digest(spark, tokenizer):
    small = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    rows = packing.pack_documents(small, PATH).selectExpr("crc32(ids) AS c", "start", "length").orderBy("start").collect()
    ids = ids_of(tokenizer, "hello world", 1)
    assert [(r.c, r.start) for r in rows] == [(zlib.crc32(np.array(ids[i:j], "<u4").tobytes()), i) for i, j in ((0, 2), (2, 3))]
