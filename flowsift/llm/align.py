"""Alignment of two tokenizers' ids over a corpus, with a fast path for ids of the same bytes.

Both token sequences of a text cover the same bytes, blank + text. The places where tokens
of both sides end cut them into groups; every overlapping pair of tokens is a link. A
link is regular if the B id is the one that the identity map gives for the A id (an
array made once from the vocabularies: A id to the B id with the same bytes). Regular
links are counted in arrays as long as the vocabulary, a row per task. Only
irregular links enter the shuffle of pairs, and they do so once a block
of documents (about ``BLOCK`` bytes of text), however many documents of the block hold them.

The corpus-wide counts then go back to the blocks: a block's own irregular pairs with
their counts meet the block's documents in a cogroup, so a task holds one block; the
counts of regular links and each A id's highest count are arrays as long as the
vocabulary, and that is all that reaches the driver or is sent to every task. A frequent
pair is one row per block. A text longer than BLOCK is a block of its own.

Defined results: texts null, empty, or not covered byte for byte by both tokenizers
(say, with the letter that stands for a blank in the B vocabulary) have no tokens: zeros and an
empty string. Rows with equal or null ids count as documents of their own. An empty
table gives an empty table; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.scratch import ship, written
from flowsift.llm.tokens import encoder, release
from flowsift.llm.words import pieces

BLOCK = 8 << 20
SLICE = 1 << 19
_sides: dict[str, Side] = {}


@dataclass
class Side:
    """The bytes of a vocabulary's entries, one after another: blob, and each id's first byte and length."""

    blob: np.ndarray
    first: np.ndarray
    size: np.ndarray
    entries: list[bytes]
    bytewise: np.ndarray
    model: object = None

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        long = self.size[ids]
        index = np.repeat(self.first[ids] - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))
        return self.blob[index]


def _side(entries: list[bytes], bytewise: list[bool], model: object = None) -> Side:
    size = np.array([len(e) for e in entries], np.int64)
    blob = np.frombuffer(b"".join(entries), np.uint8)
    return Side(blob, np.cumsum(size) - size, size, entries, np.array(bytewise, bool), model)


def side_a(path: str) -> Side:
    """A byte-level BPE of the tokenizers library."""
    if path not in _sides:
        from tokenizers import Tokenizer

        tokenizer = encoder(path, plain=True)
        byte = {letter: b for b, letter in tokenizer.letters.items()}
        names = {i: n for n, i in Tokenizer.from_file(path).get_vocab().items()}
        entries = [names.get(i, "") for i in range(max(names) + 1)]
        coded = [bytes(byte[c] for c in e) if all(c in byte for c in e) else e.encode() for e in entries]
        _sides[path] = _side(coded, [False] * len(entries))
    return _sides[path]


def side_b(path: str) -> Side:
    """A sentencepiece model with byte fallback."""
    if path not in _sides:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        raw = [model.is_byte(i) for i in range(n)]
        names = [model.id_to_piece(i) for i in range(n)]
        entries = [bytes([int(x[3:5], 16)]) if byte else x.replace("▁", " ").encode() for x, byte in zip(names, raw, strict=True)]
        _sides[path] = _side(entries, raw, model)
    return _sides[path]


def identity_map(a: Side, b: Side) -> np.ndarray:
    """For each A id the B id with the same bytes, a piece before a single byte; -1 where there is none."""
    best: dict[bytes, int] = {}
    for i in sorted(range(len(b.entries)), key=lambda i: (bool(b.bytewise[i]), i)):
        best.setdefault(b.entries[i], i)
    return np.array([best.get(e, -1) if e else -1 for e in a.entries], np.int64)


def _digits(n: int) -> np.ndarray:
    """The decimal digits of 0 to n - 1, a row each, zero bytes behind, one place free for a mark."""
    width = len(str(n))
    text = np.arange(n).astype(f"S{width}")
    return np.concatenate([text.view(np.uint8).reshape(n, width), np.zeros((n, 1), np.uint8)], axis=1)


def _encode_b(model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lists = model.encode(texts, num_threads=1) if texts else []
    count = np.array([len(x) for x in lists], np.int64)
    flat = np.fromiter((i for x in lists for i in x), np.int64, int(count.sum()))
    return flat, count


@dataclass
class Aligned:
    """A slice of documents: per document counts and digests, and its links (document, A id, B id)."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    link_doc: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b, self.a_path = side_a(a_path), side_b(b_path), a_path
        self.same = identity_map(self.a, self.b)
        self.digits = _digits(max(len(self.a.entries), len(self.b.entries)))

    def _tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides and their documents, for the texts that both cover byte for byte."""
        filled = pc.fill_null(texts, "").cast(pa.large_string())
        there = pc.greater(pc.binary_length(filled), 0).to_numpy(zero_copy_only=False)
        some = np.flatnonzero(there)
        filled = filled.take(pa.array(some))
        lead = pc.binary_join_element_wise(pa.array([" "] * len(some), pa.large_string()), filled, pa.scalar("", pa.large_string()))
        ids_a, at = encoder(self.a_path, plain=True).encode(lead)
        ids_a, count_a = ids_a.astype(np.int64), np.diff(at)
        ids_b, count_b = _encode_b(self.b.model, filled.to_pylist())
        size = pc.binary_length(lead).to_numpy(zero_copy_only=False).astype(np.int64)
        doc_a, doc_b = np.repeat(np.arange(len(some)), count_a), np.repeat(np.arange(len(some)), count_b)
        long_a = np.bincount(doc_a, self.a.size[ids_a], len(some)).astype(np.int64)
        long_b = np.bincount(doc_b, self.b.size[ids_b], len(some)).astype(np.int64)
        good = (long_a == size) & (long_b == size)
        data = np.frombuffer(lead.buffers()[2], np.uint8)[: int(size.sum())] if len(some) else np.zeros(0, np.uint8)
        wanted = data[np.repeat(good, size)]
        odd = (self.a.bytes_of(ids_a[good[doc_a]]) != wanted) | (self.b.bytes_of(ids_b[good[doc_b]]) != wanted)
        if odd.any():
            good[np.unique(np.repeat(np.flatnonzero(good), size[good])[odd])] = False
        keep_a, keep_b = good[doc_a], good[doc_b]
        return ids_a[keep_a], some[doc_a[keep_a]], ids_b[keep_b], some[doc_b[keep_b]]

    def align(self, texts: pa.Array) -> Aligned:
        n = len(texts)
        a, doc_a, b, doc_b = self._tokens(texts)
        end_a, end_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        doc_of_group = np.empty(len(cuts), np.int64)
        doc_of_group[group_a] = doc_a
        begin = end_a - self.a.size[a]
        low, high = np.searchsorted(end_b, begin, "right"), np.searchsorted(end_b, end_a, "left")
        many = high - low + 1
        link_i = np.repeat(np.arange(len(a)), many)
        link_j = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(link_i))
        return Aligned(
            np.bincount(doc_a, minlength=n), np.bincount(doc_b, minlength=n), np.bincount(doc_of_group, minlength=n),
            np.bincount(doc_a[link_i], minlength=n), self._digests(n, a, doc_a, group_a, b, group_b, len(cuts), doc_of_group),
            doc_a[link_i], a[link_i], b[link_j],
        )

    def _digests(self, n, a, doc_a, group_a, b, group_b, groups, doc_of_group) -> list[str]:
        """sha256 of every document's groups written out; empty without tokens."""
        count_a, count_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        before_b, after_a = np.cumsum(count_b) - count_b, np.cumsum(count_a)
        rows = np.empty((len(a) + len(b), self.digits.shape[1]), np.uint8)
        place_a, place_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + after_a[group_b]
        rows[place_a], rows[place_b] = self.digits[a], self.digits[b]
        rows[:, -1] = ord(",")
        last = np.cumsum(count_a + count_b) - 1  # a group's last row
        rows[last, -1] = ord(";")
        rows[last - count_b, -1] = ord("|")
        if groups:
            ends = np.flatnonzero(np.append(doc_of_group[1:] != doc_of_group[:-1], True))
            rows[last[ends], -1] = 0
        flat = rows.ravel()
        there = flat != 0
        letters = flat[there].tobytes()
        row_doc = np.empty(len(rows), np.int64)
        row_doc[place_a], row_doc[place_b] = doc_of_group[group_a], doc_of_group[group_b]
        stop = np.cumsum(np.bincount(row_doc, there.reshape(rows.shape).sum(axis=1), n).astype(np.int64))
        spans = zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)
        return [hashlib.sha256(letters[i:j]).hexdigest() if j > i else "" for i, j in spans]


def _packed(docs: np.ndarray, values: np.ndarray, n: int) -> tuple[list[bytes], list[bytes]]:
    """For each document its distinct values, ascending, and how often each occurs, as little-endian bytes."""
    order = np.lexsort((values, docs))
    docs, values = docs[order], values[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(docs)))
    stop = np.searchsorted(docs[at], np.arange(n + 1))
    names, counts = values[at].astype("<i8"), times.astype("<u4")
    bounds = list(zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True))
    return [names[i:j].tobytes() for i, j in bounds], [counts[i:j].tobytes() for i, j in bounds]


SCAN = (
    "kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "same binary, same_n binary, pairs binary, pairs_n binary"
)
DOC, PAIRS, VECTOR = 0, 1, 2


def _scan(docs: DataFrame, a_path: str, b_path: str, block_bytes: int) -> DataFrame:
    """Rows of three kinds: a document with its links; a block's irregular pairs; a task's array of regular counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        wide = len(aligner.b.entries)
        regular = np.zeros(len(aligner.a.entries), np.int64)
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block_row() -> pa.RecordBatch:
            codes, at = np.unique(np.concatenate(held), return_inverse=True)
            return _row(PAIRS, (part << 32) + number, codes.astype("<i8").tobytes(), np.bincount(at, minlength=len(codes)).astype("<i8").tobytes())

        for batch in batches:
            for rows in pieces(batch, "text", SLICE):
                out = aligner.align(rows.column("text"))
                n = rows.num_rows
                same = aligner.same[out.link_a] == out.link_b
                same_ids, same_n = _packed(out.link_doc[same], out.link_a[same], n)
                codes = out.link_a[~same] * wide + out.link_b[~same]
                pair_ids, pair_n = _packed(out.link_doc[~same], codes, n)
                regular += np.bincount(np.frombuffer(b"".join(same_ids), "<i8"), minlength=len(regular))
                held.append(np.frombuffer(b"".join(pair_ids), "<i8"))
                size += rows.column("text").nbytes
                yield pa.record_batch([
                    pa.array([DOC] * n, pa.int32()), pa.array([(part << 32) + number] * n, pa.int64()), rows.column("doc_id"),
                    pa.array(out.n_a), pa.array(out.n_b), pa.array(out.n_groups), pa.array(out.n_links), pa.array(out.digests, pa.string()),
                    pa.array(same_ids, pa.binary()), pa.array(same_n, pa.binary()), pa.array(pair_ids, pa.binary()), pa.array(pair_n, pa.binary()),
                ], names=_NAMES)
                if size >= block_bytes:
                    yield block_row()
                    number, held, size = number + 1, [], 0
        if held:
            yield block_row()
        if regular.any():
            used = np.flatnonzero(regular)
            yield _row(VECTOR, -1, used.astype("<i8").tobytes(), regular[used].astype("<i8").tobytes())
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, SCAN)


_NAMES = [part.split()[0] for part in SCAN.split(", ")]


def _row(kind: int, block: int, values: bytes, counts: bytes) -> pa.RecordBatch:
    none = pa.array([None], pa.int64())
    blank = pa.array([None], pa.binary())
    return pa.record_batch(
        [pa.array([kind], pa.int32()), pa.array([block], pa.int64()), none, none, none, none, none, pa.array([None], pa.string()),
         blank, blank, pa.array([values], pa.binary()), pa.array([counts], pa.binary())], names=_NAMES,
    )


def _unpacked(packed: DataFrame) -> DataFrame:
    """block, code, n of each row's arrays, in batches of bounded size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, values, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                codes, n = np.frombuffer(values, "<i8"), np.frombuffer(counts, "<i8")
                for k in range(0, len(codes), 50_000):
                    part = codes[k : k + 50_000]
                    yield pa.record_batch({"block": pa.array(np.full(len(part), block)), "code": pa.array(part), "n": pa.array(n[k : k + 50_000])})

    return packed.mapInArrow(work, "block long, code long, n long")


@dataclass
class Alignment:
    """documents: the digest of every document. pairs: a_id, b_id, n_docs, best (ties included) of every linked pair."""

    documents: DataFrame
    pairs: DataFrame


def align_tokens(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK) -> Alignment:
    spark = docs.sparkSession
    ship(spark)
    scan = written(_scan(docs, a_path, b_path, block_bytes), "align-scan")
    wide, same_map = len(side_b(b_path).entries), identity_map(side_a(a_path), side_b(b_path))
    arrays = ["block", "pairs", "pairs_n"]
    # Arrays as long as the A vocabulary: regular counts, and every A id's highest count.
    regular, best = np.zeros(len(same_map), np.int64), np.zeros(len(same_map), np.int64)
    summed = _unpacked(scan.where(F.col("kind") == VECTOR).select(*arrays)).groupBy("code").agg(F.sum("n").alias("n"))
    for row in summed.collect():
        regular[row["code"]] = row["n"]
    blocks = written(_unpacked(scan.where(F.col("kind") == PAIRS).select(*arrays)), "align-pairs")
    counts = written(blocks.groupBy("code").agg(F.sum("n").alias("n")), "align-counts")
    a_id = F.floor(F.col("code") / wide).cast("long")
    for row in counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("n")).collect():
        best[row["a"]] = row["n"]
    best = np.maximum(best, regular)
    back = blocks.select("block", "code").join(counts, "code").select("block", "code", "n")
    found = (
        scan.where(F.col("kind") == DOC).drop("kind").groupBy("block")
        .cogroup(back.groupBy("block")).applyInArrow(_counted(regular, best, wide), RESULT)
    )
    some = np.flatnonzero(regular)
    level = spark.createDataFrame(
        pa.table({"a_id": some, "b_id": same_map[some], "n_docs": regular[some], "high": best[some]})
    ) if len(some) else spark.createDataFrame([], "a_id long, b_id long, n_docs long, high long")
    high = spark.createDataFrame(pa.table({"a_id": np.arange(len(best)), "high": best}))
    irregular = counts.select(a_id.alias("a_id"), (F.col("code") % wide).alias("b_id"), F.col("n").alias("n_docs")).join(high, "a_id")
    pairs = irregular.unionByName(level).select("a_id", "b_id", "n_docs", (F.col("n_docs") == F.col("high")).alias("best"))
    return Alignment(found, pairs)


RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _counted(regular: np.ndarray, best: np.ndarray, wide: int):
    """Sums over a block's documents, from the counts of its own irregular pairs and the regular counts."""

    def total(docs: pa.Table, ids: str, times: str, count, top) -> tuple[np.ndarray, np.ndarray]:
        """Per document: the sum of counts, and the number of links with the highest count."""
        values, often = docs.column(ids).to_pylist(), docs.column(times).to_pylist()
        flat, n = np.frombuffer(b"".join(values), "<i8"), np.frombuffer(b"".join(often), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(values)), [len(v) // 8 for v in values])
        found = count(flat)
        sums, tops = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        np.add.at(sums, owner, found * n)
        np.add.at(tops, owner, n * (found == top(flat)))
        return sums, tops

    def work(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        codes, n = pairs.column("code").to_numpy(), pairs.column("n").to_numpy()
        order = np.argsort(codes)
        codes, n = codes[order], n[order]
        docs = docs.combine_chunks()
        same_sum, same_top = total(docs, "same", "same_n", lambda x: regular[x], lambda x: best[x])
        pair_sum, pair_top = total(
            docs, "pairs", "pairs_n", lambda x: n[np.searchsorted(codes, x)] if len(x) else x, lambda x: best[x // wide]
        )
        return pa.table({
            **{c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
            "n_best": same_top + pair_top, "count_sum": same_sum + pair_sum, "groups_sha256": docs.column("groups_sha256"),
        })

    return work


def op11(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).documents
