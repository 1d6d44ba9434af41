"""Token ids of whole texts with a byte-level BPE of the tokenizers library, many texts at once.

Texts repeat most of their pieces (a blank and the word after it), and the
pre-tokenizer never joins across such a piece's ends. So a batch is cut into pieces,
each distinct piece is encoded once by the tokenizer's model, and the ids are put
together with numpy. A worker keeps the ids of pieces it has seen, up to
``CACHE`` pieces. Texts with other white space than blank and 0x09-0x0D are
encoded whole by the tokenizer itself, and so are texts with the string of an added
token, unless such strings are to be ordinary text (``plain``). Pieces are told apart by a 64-bit hash.
"""

from __future__ import annotations

import ctypes
import gc
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from flowsift.llm.words import _BASE, _INVERSE, _SEGMENT, _power, mix64

CACHE = 300_000
_RAW = np.random.Generator(np.random.PCG64(20240612)).integers(1, 2**63, 256, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[33, 44, 46, 58, 59, 63]] = True  # ! , . : ; ?
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_PLAIN = re.compile(r" ?(?:[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9]+|[!,.:;?]+|\n)")
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # gives the allocator's free pages back, where there is one
_workers: dict[tuple[str, bool], PieceEncoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letters that stand for the 256 bytes in byte-level BPE vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PieceEncoder:
    def __init__(self, path: str, plain: bool = False):
        """plain: strings of added tokens are ordinary text."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([_ODD.pattern, *map(re.escape, added)]))
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.clear()

    def clear(self) -> None:
        self.names = np.zeros(0, np.uint64)  # sorted hashes of known pieces
        self.slots = np.zeros(0, np.int64)  # their places in first and long
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.first = np.zeros(1 << 16, np.int64)
        self.long = np.zeros(1 << 16, np.int64)

    def _encode(self, piece: str) -> list[int]:
        if _PLAIN.fullmatch(piece):
            return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _find(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is known, and its slot."""
        if not len(self.names):
            return np.zeros(len(kinds), bool), np.zeros(len(kinds), np.int64)
        at = np.minimum(np.searchsorted(self.names, kinds), len(self.names) - 1)
        return self.names[at] == kinds, self.slots[at]

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        encoded = [self._encode(p) for p in pieces]
        long = np.array([len(x) for x in encoded], np.int64)
        n, total = len(self.names), int(long.sum())
        while n + len(keys) > len(self.first):
            self.first, self.long = (np.concatenate([a, np.zeros_like(a)]) for a in (self.first, self.long))
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = np.fromiter((i for x in encoded for i in x), np.uint32, total)
        self.first[n : n + len(keys)] = self.used + np.cumsum(long) - long
        self.long[n : n + len(keys)] = long
        order = np.argsort(keys)
        at = np.searchsorted(self.names, keys[order])
        self.names, self.slots = np.insert(self.names, at, keys[order]), np.insert(self.slots, at, n + order)
        self.used += total

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text begins (one more: the end)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        if raw is None or not len(texts) or bounds[0] == bounds[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(raw, np.uint8)[int(bounds[0]) : int(bounds[-1])]
        bounds = bounds - bounds[0]
        blob = data.tobytes()
        if self.odd.search(blob.decode()):
            return self._mixed(texts)
        return self._pieces(data, blob, bounds)

    def _mixed(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Odd texts whole by the tokenizer, the others by pieces."""
        values = texts.to_pylist()
        odd = np.array([bool(self.odd.search(v)) for v in values])
        found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(values)
        for i in np.flatnonzero(odd):
            found[i] = np.array(self.tokenizer.encode(values[i], add_special_tokens=False).ids, np.uint32)
        plain = np.flatnonzero(~odd)
        ids, at = self.encode(texts.take(pa.array(plain)))
        for k, i in enumerate(plain):
            found[i] = ids[at[k] : at[k + 1]]
        return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])

    def _pieces(self, data: np.ndarray, blob: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        blank = _BLANK[data]
        begin = np.zeros(n + 1, bool)
        begin[bounds] = True
        begin[1:n] |= blank[1:] & ~blank[:-1]
        # A single line end stands alone, and so does what follows it.
        begin[2:n] |= (data[1:-1] == 10) & ~blank[:-2] & ~blank[2:]
        begin[1:n] |= _MARK[data[1:]] & _LETTER[data[:-1]]
        begin[2:n] |= _MARK[data[2:]] & (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
        begin[n] = True
        cuts = np.flatnonzero(begin)
        starts, ends = cuts[:-1], cuts[1:]
        keys = np.empty(len(starts), np.uint64)
        parts = np.searchsorted(starts, np.arange(0, n + _SEGMENT, _SEGMENT))
        for i, j in zip(parts[:-1], parts[1:], strict=True):
            if i < j:
                lo, hi = int(starts[i]), int(ends[j - 1])
                sums = np.zeros(hi - lo + 1, np.uint64)
                np.cumsum(_RAW[data[lo:hi]] * _power(_BASE, hi - lo), out=sums[1:])
                s, e = starts[i:j] - lo, ends[i:j] - lo
                keys[i:j] = mix64((sums[e] - sums[s]) * _power(_INVERSE, hi - lo)[s] + (e - s).astype(np.uint64))
        codes, kinds = pd.factorize(keys)
        if len(self.names) + len(kinds) > max(CACHE, 2 * len(kinds)):
            self.clear()
        known, slots = self._find(kinds)
        new = np.flatnonzero(~known)
        if len(new):
            where = np.empty(len(kinds), np.int64)
            where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            spots, before = where[new], len(self.names)
            self._learn(
                kinds[new],
                [blob[a:b].decode() for a, b in zip(starts[spots].tolist(), ends[spots].tolist(), strict=True)],
            )
            slots[new] = before + np.arange(len(new))
        slot = slots[codes]
        long = self.long[slot]
        after = np.cumsum(long)
        index = np.repeat(self.first[slot] - (after - long), long) + np.arange(int(after[-1]))
        piece_at = np.searchsorted(starts, bounds)
        return self.ids[index], np.concatenate([[0], after])[piece_at]


def encoder(path: str, plain: bool = False) -> PieceEncoder:
    """This worker's encoder for the tokenizer file."""
    if (path, plain) not in _workers:
        _workers[path, plain] = PieceEncoder(path, plain)
    return _workers[path, plain]


def release() -> None:
    """At the end of a task: a worker that stays for other tasks keeps neither pieces nor freed memory."""
    for kept in _workers.values():
        kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def encode_with_end(texts: pa.Array, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """As PieceEncoder.encode, with the id ``end`` after each text."""
    ids, at = encoder(path).encode(texts)
    out = np.empty(len(ids) + len(texts), np.uint32)
    ends = at[1:] + np.arange(len(texts))
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep] = ids
    out[ends] = end
    return out, at + np.arange(len(texts) + 1)
