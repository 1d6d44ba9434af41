"""Hierarchical packing of token streams into windows of several lengths.

Tiers are the powers of two from ``least`` to ``length`` tokens. A document longer
than the longest tier gives full windows first. What is left of it, or the
document itself, is routed to the smallest tier that holds it. Tiers are packed
from the longest to the shortest: every document opens a window of its tier, and
the window's gap is filled with whole documents of shorter tiers, longest first,
and at last with a cut piece. So windows are full powers of two, which need
no padding. What is too short for a window of the least tier waits for the next unit;
at the end of a task such a rest is cut into windows of yet smaller powers of two.

A unit of about ``unit_tokens`` tokens is packed at once, inside the task that
reads and encodes the documents: no shuffle, and memory that doesn't grow with
the data. Windows get a step group: windows of a unit are dealt, longest first, to
the group with the fewest tokens, so that groups are alike in size and in tiers.

Defined results: a null or empty text is its end id alone; rows with equal or null
ids are packed each; an empty table has no pieces. Very long texts are cut, like
all others. Other columns of the input take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.scratch import ship
from flowsift.llm.tokens import encode_with_end, release
from flowsift.llm.words import pieces

SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, step_group long, ids binary"
)


class _Tiers:
    """Open pieces by tier: stacks of (document, start, length) by exact length, for best fits."""

    def __init__(self, longest: int):
        self.by_length: list[list[tuple[int, int]]] = [[] for _ in range(longest)]
        self.count = np.zeros(longest, np.int64)
        self.total = 0

    def put(self, doc: int, start: int, length: int) -> None:
        if length:
            self.by_length[length].append((doc, start))
            self.count[length] += 1
            self.total += length

    def take(self, length: int) -> tuple[int, int, int]:
        doc, start = self.by_length[length].pop()
        self.count[length] -= 1
        self.total -= length
        return doc, start, length

    def longest_up_to(self, limit: int) -> int:
        """The greatest length present that is at most ``limit``, else 0."""
        present = np.flatnonzero(self.count[1 : limit + 1])
        return int(present[-1]) + 1 if len(present) else 0

    def shortest(self) -> int:
        present = np.flatnonzero(self.count)
        return int(present[0]) if len(present) else 0


def pack_unit(
    lengths: np.ndarray, length: int, least: int, last: bool, starts: np.ndarray | None = None
) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """Windows as (length, pieces as (document, start, length)), and the pieces left over (none if ``last``:
    then tiers go down to one token, so that every window is full).

    lengths: tokens of each document; starts: where each begins inside its whole document.
    """
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    open_ = _Tiers(length)
    for doc, n in enumerate(lengths.tolist()):
        begin = int(starts[doc]) if starts is not None else 0
        full = n // length
        windows += [(length, [(doc, begin + k * length, length)]) for k in range(full)]
        open_.put(doc, begin + full * length, n - full * length)
    tier, least = length, 1 if last else least
    while tier >= least:
        while open_.total:
            if open_.total < tier:
                break  # not enough for a full window of this tier
            n = open_.longest_up_to(min(tier, length - 1))
            if 0 < n <= tier // 2 and tier > least:
                break  # the rest belongs to shorter tiers
            window, gap = ([open_.take(n)], tier - n) if n else ([], tier)
            while gap:
                fit = open_.longest_up_to(min(gap, length - 1))
                if fit:
                    window.append(open_.take(fit))
                    gap -= fit
                else:
                    doc, start, long = open_.take(open_.shortest())
                    window.append((doc, start, gap))
                    open_.put(doc, start + gap, long - gap)
                    gap = 0
            windows.append((tier, window))
        tier //= 2
    rest = []
    while open_.total:
        rest.append(open_.take(open_.shortest()))
    return windows, rest


def step_groups(sizes: list[int], group_tokens: int) -> list[int]:
    """A group for each window: longest first, each to the group with the fewest tokens."""
    n = max(1, round(sum(sizes) / group_tokens))
    queue = [(0, g) for g in range(n)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        tokens, g = heapq.heappop(queue)
        out[i] = g
        heapq.heappush(queue, (tokens + sizes[i], g))
    return out


def pack_documents(
    docs: DataFrame, tokenizer: str, end: int = 1, length: int = 2048, least: int = 128,
    unit_tokens: int = 1 << 20, group_tokens: int = 1 << 17,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset,
    sequence_length (padded), step_group, ids (little-endian unsigned 32-bit).
    """
    ship(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 36
        # Of each waiting document or rest: id, all its tokens, where the kept ids begin, the ids.
        names: list[int | None] = []
        totals: list[int] = []
        begins: list[int] = []
        kept: list[np.ndarray] = []
        waiting, sequence, group = 0, 0, 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal names, totals, begins, kept, waiting, sequence, group
            lengths = np.array([len(x) for x in kept], np.int64)
            windows, rest = pack_unit(lengths, length, least, last, np.array(begins, np.int64))
            groups = step_groups([w for w, _ in windows], group_tokens)
            rows = [
                (d, start, n, task + sequence + i, w, g)
                for i, ((w, parts), g) in enumerate(zip(windows, groups, strict=True)) for d, start, n in parts
            ]
            for k in range(0, len(rows), 2000):
                some = rows[k : k + 2000]
                d, start, n, seq, w, g = (np.array(x, np.int64) for x in zip(*some, strict=True))
                yield_ids = [kept[a][b - begins[a] : b - begins[a] + c].tobytes() for a, b, c in zip(d, start, n, strict=True)]
                offset = np.concatenate([[carry if seq[0] == carry_seq else 0], np.zeros(len(n) - 1, np.int64)]) if k else np.zeros(len(n), np.int64)
                for i in range(1, len(n)):
                    offset[i] = offset[i - 1] + n[i - 1] if seq[i] == seq[i - 1] else 0
                carry, carry_seq = offset[-1] + n[-1], seq[-1]
                yield pa.record_batch({
                    "doc_id": pa.array([names[a] for a in d], pa.int64()), "start": pa.array(start), "length": pa.array(n),
                    "doc_tokens": pa.array([totals[a] for a in d], pa.int64()), "sequence_id": pa.array(seq), "offset": pa.array(offset),
                    "sequence_length": pa.array(w), "step_group": pa.array(task + group + g), "ids": pa.array(yield_ids, pa.binary()),
                })
            sequence += len(windows)
            group += max(groups, default=-1) + 1
            left = [(names[d], totals[d], start, kept[d][start - begins[d] : start - begins[d] + n].copy()) for d, start, n in rest]
            names, totals, begins, kept = ([x[i] for x in left] for i in range(4))
            waiting = sum(len(x) for x in kept)

        for batch in batches:
            for part in pieces(batch, "text", 1 << 18):
                ids, at = encode_with_end(part.column("text"), tokenizer, end)
                own = part.column("doc_id").to_pylist()
                for i, name in enumerate(own):
                    names.append(name)
                    totals.append(int(at[i + 1] - at[i]))
                    begins.append(0)
                    kept.append(ids[at[i] : at[i + 1]])
                    waiting += totals[-1]
                    if waiting >= unit_tokens:
                        yield from flush(False)
        if kept:
            yield from flush(True)
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, SCHEMA)


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "sequence_length", "step_group",
    )
