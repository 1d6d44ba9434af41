"""Words of a column of texts as numpy arrays: bounds and 64-bit hashes, whole batches at once.

A word is a run of bytes other than blank and 0x09-0x0D; A-Z are lower-cased. In
UTF-8 these bytes occur in no other character, so bounds found on bytes are right.
A word's hash is a polynomial over random byte values, mixed with its length; it
depends on the word alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_MARKS = np.zeros(256, bool)
_MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_VALUES = np.random.Generator(np.random.PCG64(20240611)).integers(1, 2**63, 256, dtype=np.uint64)[FOLD]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SEGMENT = 1 << 18
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(str(base))
    if known is None or len(known) < n:
        steps = np.full(max(n, _SEGMENT + 4096), base, np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if n <= 4 * _SEGMENT:
            _powers[str(base)] = known
    return known[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """data: bytes of all texts; starts, ends: bounds of words; doc_at: first word of each text, and the number of words."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first, last = (int(bounds[0]), int(bounds[-1])) if len(bounds) else (0, 0)
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[first:last] if raw is not None else np.zeros(0, np.uint8)
        self.bounds = bounds - first
        n = last - first
        inside = np.zeros(n + 2, bool)
        np.logical_not(_SEP[self.data], out=inside[1:-1])
        edge = np.zeros(n + 1, bool)
        edge[self.bounds] = True
        self.starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        self.ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.doc_at = np.searchsorted(self.starts, self.bounds)

    def trim(self) -> None:
        """Take ASCII marks off both ends of words; words of marks only keep their first one."""
        while True:
            more = (self.ends - self.starts > 1) & _MARKS[self.data[self.ends - 1]] if len(self) else np.zeros(0, bool)
            if not more.any():
                break
            self.ends = self.ends - more
        while True:
            more = (self.ends - self.starts > 1) & _MARKS[self.data[self.starts]] if len(self) else np.zeros(0, bool)
            if not more.any():
                break
            self.starts = self.starts + more

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        cuts = np.searchsorted(self.starts, np.arange(0, len(self.data) + _SEGMENT, _SEGMENT))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            lo, hi = int(self.starts[i]), int(self.ends[j - 1])
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_VALUES[self.data[lo:hi]] * _power(_BASE, hi - lo), out=sums[1:])
            s, e = self.starts[i:j] - lo, self.ends[i:j] - lo
            value = (sums[e] - sums[s]) * _power(_INVERSE, hi - lo)[s]
            out[i:j] = mix64(value + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return out

    def doc_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.doc_at))


def pieces(batch: pa.RecordBatch, text: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows with about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    part = sizes // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(i, j - i)
