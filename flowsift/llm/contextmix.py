"""Language-model scoring by online logistic context mixing.

A text is a row of words and one end. Every word is coded in binary decisions: the
path of a Huffman tree over the ``vocabulary`` most frequent training words (counted
exactly over the whole corpus), the end and an escape; an escaped word is spelled, letter by letter, by a
second tree over bytes. Each decision is predicted by several counters in hashed
contexts (for words: the word before, the last frequent word, the last two frequent
words; for letters: one, two, three and five letters before; the tree itself is balanced by plain frequency). The counters' log-odds are added with
weights of the gate that fits how much the contexts have been seen, and the result is
refined by a table of outcomes by node class and predicted odds. The sum of
log2 over all decisions is the text's code length; divided by its bytes it gives bits per byte.

Training is online in every task: predict a block, move the weights along the error,
then count. Tasks' counters are summed, their weights averaged by the number of
decisions. Scoring uses the merged model as it stands, so a text's score doesn't
depend on other texts or on their order. Counters have fixed numbers of slots, so what tasks receive is bounded
(``vocabulary`` words and about 2.5 million slots); word counts and what the
counters are gathered from cover all training texts and grow with them.

Exact counts of rare words (for the unigram base score) are looked up by hash buckets in
a shuffle, never broadcast.

Defined results: a null or empty text is the end alone; rows with equal or null ids are
scored each (a null id counts as the text ""); without training texts all words
are spelled by untrained counters. Other columns of the input take no part.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.neardup import by_key
from flowsift.llm.scratch import ship, written
from flowsift.llm.words import FOLD, Words, mix64, pieces

SPREAD, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
WORD_SLOTS, LETTER_SLOTS = (19, 19, 19), (16, 17, 18, 19)
GATES, ODDS, CLASSES = 81, 24, 64
CHUNK = 1 << 16
#: What an outcome adds to the two counts of a slot, taken as one number.
ONE_OF = np.array([[1, 0], [0, 1]], np.int32).view(np.int64).ravel()
#: Decisions that are worked on at once.
STRETCH = 1 << 15
#: Bytes of text that a task works on at once.
PIECE = 3 << 19


def pick(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values at places that are all valid, which numpy need not check."""
    return np.take(values, at, mode="clip")


class Code:
    """A Huffman code: for every symbol its nodes and decisions."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        queue = [(float(c) + 0.5, i) for i, c in enumerate(counts)]
        heapq.heapify(queue)
        up, side, top = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int8), n
        while len(queue) > 1:
            (a, i), (b, j) = heapq.heappop(queue), heapq.heappop(queue)
            up[i] = up[j] = top
            side[j] = 1
            heapq.heappush(queue, (a + b, top))
            top += 1
        paths, bits = [], []
        for s in range(n):
            path, bit, at = [], [], s
            while at != top - 1:
                bit.append(side[at])
                at = up[at]
                path.append(at - n)
            paths.append(path[::-1])
            bits.append(bit[::-1])
        self.long = np.array([len(p) for p in paths], np.int64)
        self.first = np.cumsum(self.long) - self.long
        nodes = np.array([x for p in paths for x in p], np.uint64)
        self.salts = nodes * TURN * SPREAD
        self.cells = ((nodes & np.uint64(CLASSES - 1)) * np.uint64(ODDS)).astype(np.int32)
        self.bits = np.array([x for b in bits for x in b], np.int8)

    def expand(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all decisions: index of the symbol, the node's salt, its class in the refining table, outcome."""
        long = self.long[symbols]
        of = np.repeat(np.arange(len(symbols)), long)
        flat = np.arange(len(of)) + np.repeat(self.first[symbols] - (np.cumsum(long) - long), long)
        return of, pick(self.salts, flat), pick(self.cells, flat), pick(self.bits, flat)


@dataclass
class Mixer:
    """Counters in hashed contexts, weights by gate, and the refining table."""

    slots: tuple[int, ...]
    counts: list[np.ndarray] = field(default_factory=list)  # rows: outcomes 0 and 1
    odds: list[np.ndarray] = field(default_factory=list)  # frozen: log-odds; the last two bits say how much was seen
    weights: np.ndarray | None = None
    refine: np.ndarray | None = None
    seen: int = 0
    _table: np.ndarray | None = None

    def __post_init__(self) -> None:
        if not self.counts and not self.odds:
            self.counts = [np.zeros((1 << b, 2), np.int32) for b in self.slots]
        if self.weights is None:
            self.weights = np.full((GATES, len(self.slots)), 0.2, np.float32)
        if self.refine is None:
            self.refine = np.zeros((CLASSES * ODDS, 2), np.int64)

    def _slots(self, spread: list[np.ndarray], of: np.ndarray, salt: np.ndarray) -> list[np.ndarray]:
        """``spread``: contexts times ``SPREAD``, as the salts are."""
        out = []
        for c, b in zip(spread, self.slots, strict=True):
            slot = pick(c, of)
            slot += salt
            slot >>= np.uint64(64 - b)
            out.append(slot.view(np.int64))
        return out

    def _inputs(self, slots: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Log-odds of each counter, and the gate: how much each context was seen (0 to 2)."""
        inputs, gate = [], None
        for p, slot in enumerate(slots):
            if self.odds:
                x = pick(self.odds[p], slot)
                sure = (x.view(np.uint32) & np.uint32(3)).astype(np.int8)
            else:
                x, sure = _log_odds(pick(self.counts[p].view(np.int64).ravel(), slot).view(np.int32).reshape(-1, 2))
            inputs.append(x)
            gate = sure if gate is None else gate * np.int8(3) + sure
        return inputs, gate.astype(np.intp)

    def _mix(self, inputs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        z = np.zeros(len(gate), np.float32)
        for p, x in enumerate(inputs):
            part = pick(np.ascontiguousarray(self.weights[:, p]), gate)
            part *= x
            z += part
        return np.clip(z, -11, 11, out=z)

    def predict(self, contexts: list[np.ndarray], of: np.ndarray, salt: np.ndarray, cell: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of every outcome."""
        inputs, gate = self._inputs(self._slots([c * SPREAD for c in contexts], of, salt))
        z = self._mix(inputs, gate)
        cell = _cell(cell, z)
        p1 = np.exp(np.negative(z, out=z), out=z)
        p1 += 1
        np.divide(np.float32(0.7), p1, out=p1)
        p1 += pick(self._refined(), cell)
        np.clip(p1, 1e-5, 1 - 1e-5, out=p1)
        p1 += bit
        p1 -= 1  # so its absolute value is the outcome's probability
        return np.log(np.abs(p1, out=p1), out=p1)

    def _refined(self) -> np.ndarray:
        if self._table is None:
            self._table = (0.3 * (self.refine[:, 1] + 8 * _middle()) / (self.refine.sum(1) + 8)).astype(np.float32)
        return self._table

    def learn(
        self, contexts: list[np.ndarray], of: np.ndarray, salt: np.ndarray, cell: np.ndarray, bit: np.ndarray, times: np.ndarray | None = None
    ) -> None:
        """Predict with what is known so far, step along the error, then count; a decision is made ``times`` (once, if not given).

        The decisions go through in stretches that stay in the processor's cache; sums are added in order of the decisions.
        """
        steps = np.zeros((len(self.slots), GATES), complex)  # per weight: the pull of the errors, and the bend
        hits: list[list[np.ndarray]] = [[] for _ in self.slots]
        seen, spread_ = [], [c * SPREAD for c in contexts]
        for at in range(0, len(bit), STRETCH):
            s = slice(at, at + STRETCH)
            slots, b = self._slots(spread_, of[s], salt[s]), bit[s]
            inputs, gate = self._inputs(slots)
            z = self._mix(inputs, gate)
            one = 1 / (1 + np.exp(-z))
            error, spread = b - one, one * (1 - one)
            n = None if times is None else pick(times, of[s])
            if n is not None:
                error *= n
                spread *= n
            for p, x in enumerate(inputs):
                both = np.empty(len(b), complex)  # two sums in one pass
                pull = error * x
                both.real = pull
                np.multiply(spread, x, out=pull)
                pull *= x
                both.imag = pull
                np.add.at(steps[p], gate, both)
            self.refine += np.bincount(_cell(cell[s], z) * 2 + b, n, 2 * len(self.refine)).astype(np.int64).reshape(-1, 2)
            seen.append(pick(ONE_OF, b) if n is None else pick(ONE_OF, b) * n.astype(np.int64))
            for held, slot in zip(hits, slots, strict=True):
                held.append(slot)
        for p in range(len(self.slots)):  # a Newton step for each weight of each gate
            self.weights[:, p] += (0.5 / len(self.slots) * steps[p].real / (steps[p].imag + 100)).astype(np.float32)
        np.clip(self.weights, -1, 3, out=self.weights)
        for counts, held in zip(self.counts, hits, strict=True):
            both = counts.view(np.int64).ravel()
            for slot, n in zip(held, seen, strict=True):
                np.add.at(both, slot, n)  # of the counters' type, which is the fast way
        self.seen += len(bit) if times is None else int(pick(times, of).sum(dtype=np.float64))


def _cell(cell: np.ndarray, z: np.ndarray) -> np.ndarray:
    return cell + ((z + np.float32(11.5)) * np.float32((ODDS - 1) / 23)).astype(np.int32)


def pack_odds(odds: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Log-odds whose last two bits hold how much was seen."""
    return ((odds.astype(np.float32).view(np.uint32) & np.uint32(0xFFFFFFFC)) | sure.astype(np.uint32)).view(np.float32)


def _log_odds(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of outcome 1, and how much was seen: 0, 1 (up to three times) or 2."""
    none, one = pair[:, 0].astype(np.float32), pair[:, 1].astype(np.float32)
    total = none + one
    none += np.float32(0.4)
    one += np.float32(0.4)
    one /= none
    return np.log(one, out=one), (total > 0).view(np.int8) + (total > 3).view(np.int8)


def _middle() -> np.ndarray:
    """Probability in the middle of each class of odds."""
    z = np.arange(ODDS) * 23 / (ODDS - 1) - 11.5
    return np.tile(1 / (1 + np.exp(-z)), CLASSES)


@dataclass
class Vocabulary:
    """Frequent words by hash: symbols 0.. by rank; then the end and the escape."""

    names: np.ndarray  # sorted
    ranks: np.ndarray
    counts: np.ndarray  # by rank, then of the end and the escape
    letters: np.ndarray  # of 256 bytes, then of the end of a word

    def __post_init__(self) -> None:
        self.end, self.escape = len(self.names), len(self.names) + 1
        self.words, self.spelling = Code(self.counts), Code(self.letters)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.full(len(hashes), self.escape)
        at = np.minimum(np.searchsorted(self.names, hashes), len(self.names) - 1)
        return np.where(self.names[at] == hashes, self.ranks[at], self.escape)


FREQUENT = 64
LETTERS = (1, 2, 3, 5)
START = np.uint64(0x2545F4914F6CDD1D)


def _encode(words: Words, vocabulary: Vocabulary, codes: np.ndarray, kinds: np.ndarray):
    """Per token (words of each text, then its end): symbol, the contexts, the text, whether it is a word, and a number of symbol and contexts."""
    n = np.diff(words.doc_at)
    doc = np.repeat(np.arange(len(n)), n + 1)
    ends = np.cumsum(n + 1) - 1
    is_word = np.ones(len(doc), bool)
    is_word[ends] = False
    symbols = np.full(len(doc), vocabulary.end)
    symbols[is_word] = vocabulary.symbols(kinds)[codes]
    first = np.concatenate([[0], ends[:-1] + 1])
    before = np.empty(len(doc), np.uint64)
    before[1:] = np.minimum(symbols[:-1], np.int64(vocabulary.escape)).astype(np.uint64)
    before[first] = START
    at = np.arange(len(doc))
    common = (symbols < FREQUENT) & is_word

    def last(flags: np.ndarray) -> np.ndarray:
        """Place of the last flagged token before each token, in its text; else -1."""
        seen = np.maximum.accumulate(np.where(flags, at, -1))
        seen = np.concatenate([[-1], seen[:-1]])
        return np.where(seen >= first[doc], seen, -1)

    one = last(common)
    two = np.where(one >= 0, one[np.maximum(one, 0)], -1)
    name = lambda i: np.where(i >= 0, symbols[np.maximum(i, 0)], FREQUENT).astype(np.uint64)
    pair = name(one) * np.uint64(FREQUENT + 1) + name(two)
    contexts = [mix64(before + np.uint64(1)), mix64(name(one) + np.uint64(10_000_000)), mix64(pair + np.uint64(20_000_000))]
    base = vocabulary.escape + 2
    same = (symbols.astype(np.uint64) * np.uint64(base) + np.minimum(before, np.uint64(base - 1))) * np.uint64((FREQUENT + 1) ** 2) + pair
    return symbols, contexts, doc, is_word, same


def _letter_symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Letters of words, each word with its end symbol 256: symbols, index of the word, place in the word."""
    long = ends - starts
    word = np.repeat(np.arange(len(starts)), long + 1)
    stop = np.cumsum(long + 1) - 1
    inside = np.ones(len(word), bool)
    inside[stop] = False
    flat = np.arange(len(word)) - np.repeat(stop - long, long + 1)
    symbols = np.full(len(word), 256)
    symbols[inside] = FOLD[data[(np.repeat(starts, long + 1) + flat)[inside]]]
    return symbols, word, flat


def _letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Letters of words, each word with its end symbol 256: symbols, contexts, index of the word, and a number of symbol and contexts."""
    symbols, word, flat = _letter_symbols(data, starts, ends)
    contexts, held = [], np.zeros(len(word), np.uint64)
    for k in range(1, max(LETTERS) + 1):
        back = np.zeros(len(word), np.uint64)
        back[k:] = symbols[:-k] + 1
        back[flat < k] = 0
        held = held * np.uint64(257) + back
        if k in LETTERS:
            contexts.append(mix64(held + np.uint64(k)))
    return symbols, contexts, word, held * np.uint64(257) + symbols.astype(np.uint64)


def _steps(code: Code, symbols: np.ndarray, limit: int = 1 << 16) -> Iterator[slice]:
    """Slices of symbols with about ``limit`` decisions each."""
    at = np.cumsum(code.long[symbols]) // limit
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(symbols)]
    yield from (slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)


def _log2(mixer: Mixer, code: Code, symbols: np.ndarray, contexts: list[np.ndarray], same: np.ndarray | None = None) -> np.ndarray:
    """log2 of the probability of each symbol; of those with the same number of symbol and contexts it is worked out once."""
    again = None
    if same is not None:
        again, _, one = _first_places(same)
        symbols, contexts = symbols[one], [c[one] for c in contexts]
    out = np.zeros(len(symbols))
    for s in _steps(code, symbols):
        of, salt, cell, bit = code.expand(symbols[s])
        out[s] = np.bincount(of, mixer.predict([c[s] for c in contexts], of, salt, cell, bit), s.stop - s.start)
    out /= np.log(2)
    return out if again is None else out[again]


def _learn(mixer: Mixer, code: Code, symbols: np.ndarray, contexts: list[np.ndarray], same: np.ndarray | None = None) -> None:
    """Small blocks at first, so that the weights follow the first counts; then an eighth of what was seen.

    In a block symbols with the same number of symbol and contexts are one, with the times it occurs.
    """
    after, at = np.cumsum(code.long[symbols]), 0
    while at < len(symbols):
        limit = min(1 << 20, max(1 << 11, mixer.seen // 8))
        end = int(np.searchsorted(after, (after[at - 1] if at else 0) + limit)) + 1
        s = slice(at, min(end, len(symbols)))
        some, near, times = symbols[s], [c[s] for c in contexts], None
        if same is not None:
            codes, _, one = _first_places(same[s])
            some, near, times = some[one], [c[one] for c in near], np.bincount(codes).astype(np.float32)
        mixer.learn(near, *code.expand(some), times)
        at = s.stop


class _Spelled:
    """Kinds of words that a task has spelled already, with their log2; emptied at a million."""

    def __init__(self) -> None:
        self.names, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.names):
            return np.zeros(len(names), bool), np.zeros(len(names))
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return self.names[at] == names, self.values[at]

    def add(self, names: np.ndarray, values: np.ndarray) -> None:
        if len(self.names) > 1_000_000:
            self.__init__()
        order = np.argsort(names)
        at = np.searchsorted(self.names, names[order])
        self.names, self.values = np.insert(self.names, at, names[order]), np.insert(self.values, at, values[order])


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _held(part: pa.RecordBatch) -> np.ndarray:
    return np.array([is_held_out(i) for i in part.column("doc_id").to_pylist()], bool)


def _kinds(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of each word, hash and first place of each kind of word."""
    return _first_places(words.hashes())


def _first_places(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of each name; each distinct name and its first place."""
    codes, kinds = pd.factorize(names)
    spot = np.empty(len(kinds), np.int64)
    spot[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, kinds, spot


def _word_counts(buckets: int):
    """Counts of training words of a task, by hash bucket; and its letters, for each kind once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        letters, texts = np.zeros(257, np.int64), 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            names, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            return names, np.bincount(at, np.concatenate([c for _, c in held]), len(names)).astype(np.int64)

        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(part.column("text"))
                train = ~_held(part)
                texts += int(train.sum())
                if not len(words):
                    continue
                codes, kinds, spot = _kinds(words)
                counts = np.bincount(codes, train[words.doc_of()], len(kinds)).astype(np.int64)
                some = counts > 0
                held.append((kinds[some], counts[some]))
                s, e = words.starts[spot[some]], words.ends[spot[some]]
                letters += np.bincount(_letter_symbols(words.data, s, e)[0], minlength=257)
                if len(held) >= 16:
                    held = [merged()]
        names, counts = merged() if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        bucket = (names >> np.uint64(40)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        for b in range(buckets):
            own = order[cuts[b] : cuts[b + 1]]
            if len(own):
                yield pa.record_batch({"bucket": pa.array([b]), "names": pa.array([names[own].tobytes()], pa.binary()), "counts": pa.array([counts[own].tobytes()], pa.binary())})
        extra = np.append(letters, texts)
        yield pa.record_batch({"bucket": pa.array([-1]), "names": pa.array([b""], pa.binary()), "counts": pa.array([extra.tobytes()], pa.binary())})

    return run


def _sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket: all its words, sorted, with their counts; in bucket -1 letters and texts."""
    for table, at in by_key(batches, ["bucket"]):
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            part = table.slice(a, b - a)
            bucket = part.column("bucket")[0].as_py()
            counts = [np.frombuffer(x, np.int64) for x in part.column("counts").to_pylist()]
            if bucket < 0:
                names, total = np.zeros(0, np.uint64), np.sum(counts, axis=0)
            else:
                names, index = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in part.column("names").to_pylist()]), return_inverse=True)
                total = np.bincount(index, np.concatenate(counts), len(names)).astype(np.int64)
            levels = np.bincount(np.minimum((np.log2(np.maximum(total, 1)) * 16).astype(np.int64), 1023), minlength=1024) if bucket >= 0 else np.zeros(1024, np.int64)
            yield pa.record_batch({
                "bucket": pa.array([bucket]), "names": pa.array([names.tobytes()], pa.binary()), "counts": pa.array([total.tobytes()], pa.binary()),
                "n": pa.array([int(total.sum())]), "kinds": pa.array([len(names)]), "levels": pa.array([levels.tobytes()], pa.binary()),
            })


def _train(vocabulary: Vocabulary):
    """Online training in a task; its counters in chunks, its weights and refining tables at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_mixer, letter_mixer, any_ = Mixer(WORD_SLOTS), Mixer(LETTER_SLOTS), False
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                part = part.filter(pa.array(~_held(part)))
                if not part.num_rows:
                    continue
                any_ = True
                words = Words(part.column("text"))
                codes, kinds, _ = _kinds(words)
                symbols, contexts, _, is_word, _ = _encode(words, vocabulary, codes, kinds)
                _learn(word_mixer, vocabulary.words, symbols, contexts)
                rare = np.flatnonzero(symbols[is_word] == vocabulary.escape)
                if len(rare):  # what scoring spells: the escaped words, as often as they occur
                    letters, contexts, _, same = _letters(words.data, words.starts[rare], words.ends[rare])
                    _learn(letter_mixer, vocabulary.spelling, letters, contexts, same)
        if not any_:
            return
        for level, mixer in enumerate((word_mixer, letter_mixer)):
            for p, table in enumerate(mixer.counts):
                for k in range(0, len(table), CHUNK):
                    cells = table[k : k + CHUNK]
                    if cells.any():
                        yield pa.record_batch({"level": pa.array([level]), "p": pa.array([p]), "chunk": pa.array([k // CHUNK]), "data": pa.array([cells.tobytes()], pa.binary())})
            tail = np.concatenate([[mixer.seen], mixer.weights.ravel() * float(mixer.seen), mixer.refine.ravel()]).astype(np.float64)
            yield pa.record_batch({"level": pa.array([level]), "p": pa.array([-1]), "chunk": pa.array([0]), "data": pa.array([tail.tobytes()], pa.binary())})

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the tasks' counters, frozen to log-odds; sums of weights and refining tables."""
    key, total = None, None

    def row() -> pa.RecordBatch:
        level, p, chunk = key
        data = total
        if p >= 0:
            odds, sure = _log_odds(total)
            data = pack_odds(odds, sure)
        return pa.record_batch({"level": pa.array([level]), "p": pa.array([p]), "chunk": pa.array([chunk]), "data": pa.array([data.tobytes()], pa.binary())})

    for batch in batches:
        for level, p, chunk, data in zip(*[batch.column(c).to_pylist() for c in ("level", "p", "chunk", "data")], strict=True):
            own = np.frombuffer(data, np.float64) if p < 0 else np.frombuffer(data, np.int32).reshape(-1, 2).astype(np.int64)
            if (level, p, chunk) == key:
                total = total + own
            else:
                if key is not None:
                    yield row()
                key, total = (level, p, chunk), own.copy()
    if key is not None:
        yield row()


@dataclass
class LanguageModel:
    vocabulary: Vocabulary
    words: Mixer
    letters: Mixer
    train_tokens: int
    kinds: int
    counts: np.ndarray  # of the vocabulary, by rank
    end_count: int


def fit_language_model(docs: DataFrame, vocabulary: int = 65_000) -> tuple[LanguageModel, DataFrame, int]:
    """The model from the training texts, the table of all word counts, and its number of buckets."""
    spark = docs.sparkSession
    ship(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = written(
        texts.mapInArrow(_word_counts(buckets), "bucket long, names binary, counts binary")
        .repartition(buckets, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(_sum_words, "bucket long, names binary, counts binary, n long, kinds long, levels binary"),
        "word-counts",
    )
    levels, n, kinds = np.zeros(1024, np.int64), 0, 0
    for r in words.where("bucket >= 0").select("n", "kinds", "levels").toLocalIterator():
        levels, n, kinds = levels + np.frombuffer(r["levels"], np.int64), n + r["n"], kinds + r["kinds"]
    above = np.cumsum(levels[::-1])[::-1]
    level = int(np.argmax(above <= vocabulary)) if (above <= vocabulary).any() else 1023
    level = max(level, 16)  # words seen once stay escaped, so the escape has their frequency

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, counts in zip(batch.column("names").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                names, counts = np.frombuffer(names, np.int64), np.frombuffer(counts, np.int64)
                some = np.minimum((np.log2(np.maximum(counts, 1)) * 16).astype(np.int64), 1023) >= level
                yield pa.record_batch({"name": pa.array(names[some]), "n": pa.array(counts[some])})

    top = words.where("bucket >= 0").select("names", "counts").mapInArrow(frequent, "name long, n long").toPandas()
    top = top.sort_values(["n", "name"], ascending=[False, True])
    names, counts = top["name"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    extra = words.where("bucket = -1").select("counts").first()
    extra = np.frombuffer(extra["counts"], np.int64) if extra else np.zeros(258, np.int64)
    texts_n = int(extra[-1])
    order = np.argsort(names)
    vocab = Vocabulary(names[order], order, np.concatenate([counts, [texts_n, max(n - int(counts.sum()), 1)]]), extra[:257])
    rows = (
        texts.mapInArrow(_train(vocab), "level long, p long, chunk long, data binary")
        .repartition("level", "p", "chunk").sortWithinPartitions("level", "p", "chunk")
        .mapInArrow(_merge, "level long, p long, chunk long, data binary")
    )
    mixers = []
    for slots in (WORD_SLOTS, LETTER_SLOTS):
        sizes = [1 << b for b in slots]
        mixers.append(Mixer(slots, odds=[np.zeros(n, np.float32) for n in sizes]))
    for r in written(rows, "model").toLocalIterator():
        mixer = mixers[r["level"]]
        if r["p"] >= 0:
            packed = np.frombuffer(r["data"], np.int32)
            cells = slice(r["chunk"] * CHUNK, r["chunk"] * CHUNK + len(packed))
            mixer.odds[r["p"]][cells] = packed.view(np.float32)
        else:
            tail = np.frombuffer(r["data"], np.float64)
            cut = 1 + mixer.weights.size
            if tail[0] > 0:
                mixer.weights = (tail[1:cut] / tail[0]).reshape(mixer.weights.shape).astype(np.float32)
            mixer.refine, mixer.seen = tail[cut:].reshape(-1, 2).astype(np.int64), int(tail[0])
    return LanguageModel(vocab, *mixers, n + texts_n, kinds + (texts_n > 0), counts, texts_n), words, buckets


def _score(model: LanguageModel, buckets: int):
    """Rows of texts (bucket -1) and of their rare words by bucket: packed hashes with the row of each."""
    v = model.vocabulary
    log_base = np.log10(model.counts + 0.1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, known_spelling = TaskContext.get().partitionId() << 40, _Spelled()
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                words = Words(part.column("text"))
                codes, kinds, spot = _kinds(words)
                symbols, contexts, doc, is_word, same = _encode(words, v, codes, kinds)
                log = _log2(model.words, v.words, symbols, contexts, same)
                kind_symbols = v.symbols(kinds)
                rare = np.flatnonzero(kind_symbols == v.escape)
                spelled = np.zeros(len(kinds))
                done, spelled[rare] = known_spelling.find(kinds[rare])
                new = rare[~done]
                if len(new):
                    letters, near, of, same = _letters(words.data, words.starts[spot[new]], words.ends[spot[new]])
                    spelled[new] = np.bincount(of, _log2(model.letters, v.spelling, letters, near, same), len(new))
                    known_spelling.add(kinds[new], spelled[new])
                log[is_word] += spelled[codes]
                m = part.num_rows
                known = is_word & (symbols < v.end)
                base = np.bincount(doc[known], log_base[symbols[known]], m)
                yield pa.record_batch({
                    "bucket": pa.array(np.full(m, -1)), "row": pa.array(row + np.arange(m)), "doc_id": part.column("doc_id"),
                    "n_tokens": pa.array(np.diff(words.doc_at) + 1), "known": pa.array(np.bincount(doc[known], minlength=m)),
                    "base": pa.array(base), "bits": pa.array(-np.bincount(doc, log, m)), "bytes": pa.array(np.diff(words.bounds)),
                    "names": pa.nulls(m, pa.binary()), "rows": pa.nulls(m, pa.binary()),
                })
                escaped = kind_symbols[codes] == v.escape
                names, rows = kinds[codes[escaped]], (row + words.doc_of()[escaped]).astype(np.int64)
                bucket = (names >> np.uint64(40)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
                for b in np.flatnonzero(np.diff(cuts)):
                    own = order[cuts[b] : cuts[b + 1]]
                    zero = pa.nulls(1, pa.int64())
                    yield pa.record_batch({
                        "bucket": pa.array([int(b)]), "row": pa.array([row]), "doc_id": zero, "n_tokens": zero, "known": zero,
                        "base": pa.nulls(1, pa.float64()), "bits": pa.nulls(1, pa.float64()), "bytes": zero,
                        "names": pa.array([names[own].tobytes()], pa.binary()), "rows": pa.array([(rows[own] - row).astype(np.int32).tobytes()], pa.binary()),
                    })
                row += m

    return run


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By bucket: first (kind 0) its words and counts, then packed rare words; packed sums for each row."""
    bucket, names, logs = None, None, None
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == 0:
                bucket, names = r["bucket"], np.frombuffer(r["names"], np.uint64)
                logs = np.log10(np.frombuffer(r["counts"], np.int64) + 0.1)
                continue
            own = np.frombuffer(r["names"], np.uint64)
            if r["bucket"] == bucket and len(names):
                at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                found = names[at] == own
                log = np.where(found, logs[at], -1.0)
            else:
                found, log = np.zeros(len(own), bool), np.full(len(own), -1.0)
            rows = np.frombuffer(r["rows"], np.int32)
            kinds, index = np.unique(rows, return_inverse=True)
            yield pa.record_batch({
                "row": pa.array([r["row"]]), "rows": pa.array([kinds.astype(np.int32).tobytes()], pa.binary()),
                "rare": pa.array([np.bincount(index, log, len(kinds)).tobytes()], pa.binary()),
                "known": pa.array([np.bincount(index, found, len(kinds)).astype(np.int32).tobytes()], pa.binary()),
            })


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets' sums of each block of texts, added up: a row for each text with rare words."""
    for table, at in by_key(batches, ["row"]):
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            part = table.slice(a, b - a)
            join = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in part.column(c).to_pylist()])  # noqa: B023, E731
            kinds, index = np.unique(join("rows", np.int32), return_inverse=True)
            yield pa.record_batch({
                "row": pa.array(part.column("row")[0].as_py() + kinds.astype(np.int64)),
                "rare": pa.array(np.bincount(index, join("rare", np.float64), len(kinds))),
                "rare_known": pa.array(np.bincount(index, join("known", np.int32), len(kinds)).astype(np.int64)),
            })


def score_texts(docs: DataFrame, vocabulary: int = 65_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, bits (the model's code length), bytes, bits_per_byte."""
    model, words, buckets = fit_language_model(docs, vocabulary)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = written(
        texts.mapInArrow(
            _score(model, buckets),
            "bucket long, row long, doc_id long, n_tokens long, known long, base double, bits double, bytes long, names binary, rows binary",
        ),
        "scored",
    )
    packed = scored.where("bucket >= 0").select("bucket", F.lit(1).alias("kind"), "names", F.lit(None).cast("binary").alias("counts"), "row", "rows")
    table = words.where("bucket >= 0").select("bucket", F.lit(0).alias("kind"), "names", "counts", F.lit(None).cast("long").alias("row"), F.lit(None).cast("binary").alias("rows"))
    rare = (
        table.unionByName(packed).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
        .mapInArrow(_look_up, "row long, rows binary, rare binary, known binary")
        .repartition("row").sortWithinPartitions("row")
        .mapInArrow(_sum_rows, "row long, rare double, rare_known long")
    )
    rows = scored.where("bucket = -1").drop("bucket", "names", "rows").join(rare, "row", "left")
    end = float(np.log10(model.end_count + 0.1))
    floor = float(np.log10(model.train_tokens + 0.1 * (model.kinds + 1)))
    base = F.col("base") + F.coalesce("rare", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(floor)
    known = F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(1 if model.end_count else 0)
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    return rows.select(
        "doc_id", held.alias("held_out"), "n_tokens", known.cast("long").alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), "bits", "bytes", F.when(F.col("bytes") > 0, F.col("bits") / F.col("bytes")).alias("bits_per_byte"),
    )


def op4(spark, sf_dir: str) -> DataFrame:
    scored = score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    score = -F.col("bits") * float(np.log10(2))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", score.alias("score"), "bits_per_byte")
