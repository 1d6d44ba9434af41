"""Personal data in texts: generous candidates, boosted trees on format and context, calibrated thresholds.

Exact patterns give the base spans: email, ip, card, phone. Beside them generators propose many
overlapping spans: obfuscated addresses, numbers with other separators, each run of neighbouring
digit groups that could be a card or a phone number. Gradient-boosted trees (Spark ML) score every
candidate by its format (digits, groups, separators, check digit) and its context (neighbouring
characters, digits and cue words nearby). A kind's threshold is the lowest score (one half at
least) from which held-out candidates are nearly always right; the best candidates above it are added where they overlap neither
base spans nor better candidates. Base spans always stay.

Nothing is labelled by hand. Candidates that are base spans are right, candidates that overlap none are
wrong, and variants of base spans written in other ways (and their spoiled counterparts, as cards with
a wrong digit) teach what the patterns miss. Trees are fitted on a bounded sample of these rows
(``max_rows`` of each label, weighed back to their natural share); a fifth of the documents,
by a hash of their text, is held out for the thresholds. Documents are scanned twice, row by row, without a shuffle; what
reaches the driver are the trees and histograms of scores.

Defined results: null texts are empty and have no spans; rows with equal or null ids are judged
each; an empty table gives an empty table; texts without any base span anywhere give no model, so nothing is
added. Places are code points, ends exclusive. Other columns are kept only by ``find_personal_data(keep=...)``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.llm.scratch import ship, written
from flowsift.llm.words import pieces

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# ---- base spans -------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @, so that long runs of letters cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order."""
    out = [(s, EMAIL, e) for s, e in _emails(text)]
    out += [(m.start(), IP, m.end()) for m in _IP.finditer(text) if all(_octet(p) for p in m.group().split("."))]
    for kind, pattern, least, most in ((CARD, _CARD, 12, 19), (PHONE, _PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if least <= len(digits) <= most and (kind == PHONE or luhn(digits)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


# ---- candidates -------------------------------------------------------------------------------

_AT = r"(?: ?@ ?| ?[(\[{] ?at ?[)\]}] ?| at )"
_DOT = r"(?:\.| ?[(\[{] ?(?:dot|\.) ?[)\]}] ?| dot )"
_LOOSE_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}", re.IGNORECASE)
_LOOSE_IP = re.compile(r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:(?: ?\. ?|[(\[{](?:\.|dot)[)\]}])[0-9]{1,3}){3}(?![A-Za-z0-9])")
_RUN = re.compile(r"(?<![A-Za-z0-9])[0-9]+(?:[ ().,/_·-]{1,3}[0-9]+)*")
_GROUP = re.compile(r"[0-9]+")
_MAYBE_EMAIL = re.compile(r"@|[(\[{] ?at ?[)\]}]| at ", re.IGNORECASE)
_HINT = re.compile(r"[0-9]")


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, digits of the whole run): spans that may overlap."""
    out = []
    if _MAYBE_EMAIL.search(text):
        out += [(m.start(), EMAIL, m.end(), 0) for m in _LOOSE_EMAIL.finditer(text)]
    if not _HINT.search(text):
        return out
    out += [(m.start(), IP, m.end(), 0) for m in _LOOSE_IP.finditer(text)]
    for run in _RUN.finditer(text):
        if run.end() - run.start() < 7 or text[run.end() : run.end() + 1].isalpha():
            continue
        groups = [g.span() for g in _GROUP.finditer(text, run.start(), run.end())]
        total = sum(e - s for s, e in groups)
        for i, (s, _) in enumerate(groups):
            digits = 0
            for j in range(i, len(groups)):
                size = groups[j][1] - groups[j][0]
                if (size == 1 and j > i) or digits + size > 19:
                    break  # cards and phone numbers go on in groups of two digits or more
                digits += size
                if digits >= 12:
                    out.append((s, CARD, groups[j][1], total))
                if 7 <= digits <= 15:
                    start = s
                    while start > 0 and s - start < 2 and text[start - 1] in "+(":
                        start -= 1
                    out.append((start, PHONE, groups[j][1], total))
    return out


# Cue words of the context features; fixed values.
_CUES = [
    re.compile(r"mail|contact|write to", re.IGNORECASE),
    re.compile(r"\bip\b|host|server|addr", re.IGNORECASE),
    re.compile(r"card|visa|master|amex|credit|karte|carte|tarjeta", re.IGNORECASE),
    re.compile(r"phone|tel\b|tel[.:]|call|mobile|fax|appel|llam|ruf", re.IGNORECASE),
]


def _side(c: str) -> float:
    return 0.0 if not c or c.isspace() else 1.0 if c.isalpha() else 2.0 if c.isdigit() else 3.0


def features(text: str, start: int, kind: int, end: int, run: int) -> list[float]:
    body = text[start:end]
    groups = _GROUP.findall(body)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    left, right = text[max(0, start - 24) : start], text[end : end + 24]
    labels = re.findall(r"[A-Za-z0-9-]+", body) or [""]
    apart = set(_NOT_DIGIT.findall(body))
    return [
        *(float(kind == k) for k in range(4)),
        len(digits), len(body), len(groups), max(sizes), *([0, 0, *sizes][-3:]), sizes[0],
        body.count(" "), body.count("."), body.count("-"), body.count("(") + body.count(")"), float(body.startswith("+")),
        float(kind == CARD and luhn(digits)), float(kind == IP and len(groups) == 4 and all(_octet(g) for g in groups)),
        len(apart), sum(c.isalpha() for c in body), float("@" in body), len(labels[-1]) if labels[-1].isalpha() else 0.0, len(labels),
        float(digits.startswith("0")), _side(left[-1:]), _side(right[:1]),
        sum(c.isdigit() for c in left), sum(c.isdigit() for c in right), *(float(bool(c.search(left))) for c in _CUES),
        float(run - len(digits)) if run else 0.0, sum(c.isupper() for c in body),
    ]


# ---- variants of base spans, to learn from ------------------------------------------------------


def _cut(digits: str, sizes: list[int], mark: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return mark.join([*out, digits[at:]] if at < len(digits) else out)


def variants(kind: int, body: str) -> list[tuple[str, int, int, int]]:
    """(text instead of the span, where the span begins and ends in it, label); an empty span: whatever lies inside."""
    digits = _NOT_DIGIT.sub("", body)
    seed = zlib.crc32(body.encode())
    if kind == EMAIL:
        name, domain = body.split("@", 1)
        forms = [f"{name} at {domain.replace('.', ' dot ')}", f"{name} (at) {domain}", f"{name}[at]{domain.replace('.', '[dot]')}", f"{name} @ {domain}"]
        return [(f, 0, len(f), 1) for f in forms] + [(f"{name} at {domain.split('.')[0]} dot {seed % 10}", 0, 0, 0)]
    if kind == IP:
        parts = body.split(".")
        wrong = [str(256 + seed % 700) if i == seed % 4 else p for i, p in enumerate(parts)]
        out = []
        for mark in ("[.]", " . ", "(.)"):
            out += [(mark.join(parts), 0, len(mark.join(parts)), 1), (mark.join(wrong), 0, len(mark.join(wrong)), 0)]
        return [*out, (".".join(wrong), 0, len(".".join(wrong)), 0)]
    if kind == CARD:
        at = seed % len(digits)
        wrong = digits[:at] + str((int(digits[at]) + 1 + seed % 8) % 10) + digits[at + 1 :]
        out = []
        for number, label in ((digits, 1), (wrong, 0)):
            if label == luhn(number):
                forms = [_cut(number, [4, 4, 4], m) for m in (".", "  ", "/", " - ")]
                out += [(f, 0, len(f), label) for f in forms]
                out += [(f"{number} {digits}", 0, len(number), label), (f"{digits} {number}", len(digits) + 1, len(digits) + 1 + len(number), label)]
        spot, phone = ".".join(_cut(digits, [2, 3, 3, 2], " ").split()[:4]), f"+1 ({digits[:3]}) {digits[3:6]}-{digits[6:10]}"
        out += [(f"{digits} {spot}", 0, len(digits), 1), (f"{phone} {digits}", len(phone) + 1, len(phone) + 1 + len(digits), 1)]
        return [*out, (_cut(digits, [2 + seed % 2] * 9, (" ", ", ", ".")[seed // 2 % 3]), 0, 0, 0)]  # a list of numbers
    short = digits[-10:]
    forms = [f"({short[:3]}) {short[3:6]}-{short[6:]}", f"{short[:3]}-{short[3:6]}-{short[6:]}", f"{short[:3]}.{short[3:6]}.{short[6:]}", body[1:]]
    plain = [digits, _cut(digits, [len(digits) % 3 or 3] + [3] * 9, "."), f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}"]
    size, mark = ((2, " "), (3, " "), (4, " "), (2, ", "), (3, ", "))[seed % 5]
    plain.append(_cut(digits + digits[::-1], [size] * 9, mark))  # a list of numbers
    beside = [_cut(digits + digits[:4], [2, 3, 3], ".")[:13], digits[-8:] + digits[-8:]]  # an address or a card behind the number
    return [(f, 0, len(f), 1) for f in forms] + [(f"{body} {b}", 0, len(body), 1) for b in beside] + [(f, 0, 0, 0) for f in plain]


def examples(text: str, folds: int = 5) -> Iterator[tuple[int, int, int, list[float]]]:
    """(fold, kind, label, features) of a text's candidates and of variants of its base spans."""
    base = base_spans(text)
    found = candidates(text)
    if not found and not base:
        return
    fold = zlib.crc32(text.encode()) % folds
    exact = {(s, k, e) for s, k, e in base}
    for s, k, e, run in found:
        if (s, k, e) in exact:
            yield fold, k, 1, features(text, s, k, e, run)
        elif not any(bs < e and s < be for bs, _, be in base):
            yield fold, k, 0, features(text, s, k, e, run)
    for s, k, e in base:
        before, after = text[max(0, s - 40) : s], text[e : e + 40]
        for body, i, j, label in variants(k, text[s:e]):
            other = before + body + after
            for cs, ck, ce, run in candidates(other):
                exactly = (cs, ce) == (len(before) + i, len(before) + j)
                if ck == k and (exactly or (j == 0 and len(before) <= cs and ce <= len(before) + len(body))):
                    yield fold, k, label, features(other, cs, ck, ce, run)


# ---- model ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Trees:
    """Boosted trees as arrays of nodes; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # weighed
    roots: np.ndarray
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            margin += self.value[at]
        return 1 / (1 + np.exp(-2 * margin))


def trees_of(model) -> Trees:
    """The nodes of a fitted GBTClassificationModel."""
    nodes: list[list[float]] = []

    def walk(node, weight: float) -> int:
        i = len(nodes)
        nodes.append([0, math.inf, i, i, node.prediction() * weight])
        if node.subtreeDepth():
            split = node.split()
            nodes[i][0], nodes[i][1] = split.featureIndex(), split.threshold()
            nodes[i][2], nodes[i][3] = walk(node.leftChild(), weight), walk(node.rightChild(), weight)
        return i

    roots = [walk(tree._java_obj.rootNode(), weight) for tree, weight in zip(model.trees, model.treeWeights, strict=True)]
    columns = [np.array(c) for c in zip(*nodes, strict=True)]
    return Trees(columns[0].astype(np.int64), columns[1], columns[2].astype(np.int64), columns[3].astype(np.int64), columns[4],
                 np.array(roots), max(tree.depth for tree in model.trees))


@dataclass(frozen=True)
class PersonalModel:
    trees: Trees | None
    thresholds: tuple[float, ...]  # by kind; above 1: no span of this kind is added


def labelled(docs: DataFrame) -> DataFrame:
    """fold, kind, label, x of all examples of the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, "text", 1 << 20):
                held: list[tuple[int, int, int, list[float]]] = []
                for text in rows.column(0).to_pylist():
                    held += examples(text or "")
                    if len(held) >= 5000:
                        yield pack(held)
                        held = []
                if held:
                    yield pack(held)

    def pack(held: list[tuple[int, int, int, list[float]]]) -> pa.RecordBatch:
        fold, kind, label, x = zip(*held, strict=True)
        return pa.record_batch({
            "fold": pa.array(fold, pa.int32()), "kind": pa.array(kind, pa.int32()), "label": pa.array(label, pa.int32()),
            "x": pa.array([[float(v) for v in r] for r in x], pa.list_(pa.float64())),
        })

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(work, "fold int, kind int, label int, x array<double>")


def _threshold(rows: list, bins: int, precision: float) -> float:
    """The lowest score from which right rows are at least ``precision`` of all, by a cautious estimate."""
    right, wrong = np.zeros(bins + 1), np.zeros(bins + 1)
    for r in rows:
        (right if r["label"] else wrong)[r["bin"]] += r["n"]
    good, bad = np.cumsum(right[::-1])[::-1], np.cumsum(wrong[::-1])[::-1]
    n = good + bad
    with np.errstate(divide="ignore", invalid="ignore"):
        share = good / n
        low = (share + 2 / n - 2 * np.sqrt(share * (1 - share) / n + 1 / n**2)) / (1 + 4 / n)  # Wilson, two standard errors
    enough = np.flatnonzero((n > 0) & (low >= precision))
    return max(0.5, float(enough[0]) / bins) if len(enough) else 2.0


def fit_personal(docs: DataFrame, max_rows: int = 20_000, rounds: int = 20, depth: int = 5, precision: float = 0.95, seed: int = 11) -> PersonalModel:
    """max_rows: the bound on the rows of each label that trees are fitted on; thresholds use all held-out rows."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    ship(docs.sparkSession)
    rows = written(labelled(docs), "personal-examples")
    sizes = {r["label"]: r["n"] for r in rows.where("fold <> 0").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return PersonalModel(None, (2.0,) * 4)
    rate = {label: min(1.0, max_rows / n) for label, n in sizes.items()}
    draw = F.pmod(F.xxhash64("x", "kind", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("label") == 1, rate[1]).otherwise(rate[0])
    # Equal rows are one row, drawn by how often it occurs, so the sample's bound holds however often a row is repeated.
    distinct = rows.where("fold <> 0").groupBy("kind", "label", "x").agg(F.count("*").cast("double").alias("n"))
    distinct = distinct.withColumn("p", F.least(F.lit(1.0), F.col("n") * share)).where(draw < F.col("p"))
    sample = distinct.select("label", array_to_vector("x").alias("features"), (F.col("n") / F.col("p")).alias("weight"))
    sample = written(sample, "personal-sample")
    if sample.select("label").distinct().count() < 2:
        return PersonalModel(None, (2.0,) * 4)
    model = GBTClassifier(
        labelCol="label", featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.8, seed=seed, cacheNodeIds=False,
    ).fit(sample)
    trees = trees_of(model)
    bins = 1000
    scored = rows.where("fold = 0").mapInArrow(_bins(trees, bins), "kind int, label int, bin int")
    counts = scored.groupBy("kind", "label", "bin").agg(F.count("*").alias("n")).collect()  # at most 4 x 2 x 1001 rows
    return PersonalModel(trees, tuple(_threshold([r for r in counts if r["kind"] == k], bins, precision) for k in range(4)))


def _bins(trees: Trees, bins: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                at = np.floor(trees.scores(x) * bins).astype(np.int32)
                yield pa.record_batch({"kind": batch.column("kind"), "label": batch.column("label"), "bin": pa.array(at)})

    return work


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"


def _chosen(base: list[tuple[int, int, int]], scored: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int, bool, float]]:
    """Base spans, and the best scored spans that overlap none of those taken before."""
    taken = [(s, k, e, True, 1.0) for s, k, e in base]
    held = sorted((s, e) for s, _, e in base)
    for score, s, k, e in sorted(scored, key=lambda c: (-c[0], c[1], c[2], -c[3])):
        if not any(a < e and s < b for a, b in held):
            held.append((s, e))
            taken.append((s, k, e, False, score))
    return sorted(taken)


def spans_of(texts: list[str], model: PersonalModel) -> list[list[tuple[int, int, int, bool, float]]]:
    """(start, kind, end, base, score) for every text."""
    bases = [base_spans(t) for t in texts]
    if model.trees is None:
        return [_chosen(b, []) for b in bases]
    owner, spots, rows = [], [], []
    for i, text in enumerate(texts):
        held = sorted((s, e) for s, _, e in bases[i])
        reach = np.maximum.accumulate(np.array([e for _, e in held], np.int64)) if held else None
        begins = np.array([s for s, _ in held], np.int64)
        for s, k, e, run in candidates(text):
            before = np.searchsorted(begins, e) - 1
            if model.thresholds[k] <= 1 and not (before >= 0 and reach[before] > s):
                owner.append(i)
                spots.append((s, k, e))
                rows.append(features(text, s, k, e, run))
    scored: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
    if rows:
        for i, (s, k, e), score in zip(owner, spots, model.trees.scores(np.array(rows, float)).tolist(), strict=True):
            if score >= model.thresholds[k]:
                scored[i].append((score, s, k, e))
    return [_chosen(b, c) for b, c in zip(bases, scored, strict=True)]


def find_personal_data(docs: DataFrame, model: PersonalModel, keep: tuple[str, ...] = ("doc_id",), name: str = "spans") -> DataFrame:
    """The columns ``keep`` and the spans of each text, in order of place and kind."""
    ship(docs.sparkSession)
    columns = [docs[f"`{c}`"] for c in keep]
    inner = [f"c{i}" for i in range(len(keep))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, "text", 1 << 20):
                found = spans_of([t or "" for t in rows.column("text").to_pylist()], model)
                spans = pa.array([
                    [{"kind": KINDS[k], "start": s, "end": e, "base": b, "score": v} for s, k, e, b, v in f] for f in found
                ], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())])))
                yield pa.record_batch([*(rows.column(c) for c in inner), spans], names=[*inner, "spans"])

    named = docs.select(*[c.alias(i) for c, i in zip(columns, inner, strict=True)], F.col("text").cast("string").alias("text"))
    types = ", ".join(f"{i} {named.schema[i].dataType.simpleString()}" for i in inner)
    out = named.mapInArrow(work, f"{types}, spans {SPANS}")
    return out.select(*[F.col(i).alias(c) for i, c in zip(inner, keep, strict=True)], F.col("spans").alias(name))


def redacted(text: Column, spans: Column) -> Column:
    """The text with ``<kind>`` instead of each span; where spans overlap, the first one hides the others' common part."""
    begin = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(done: Column, span: Column) -> Column:
        start, end = span["start"] + 1, span["end"] + 1
        shown = F.when(start >= done["at"], F.concat(done["out"], F.substring(text, done["at"], start - done["at"]), F.lit("<"), span["kind"], F.lit(">")))
        return F.struct(shown.otherwise(done["out"]).alias("out"), F.greatest(done["at"], end).alias("at"))

    return F.aggregate(spans, begin, step, lambda done: F.concat(done["out"], F.substring(text, done["at"], F.length(text))))


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_personal_data(docs, fit_personal(docs))

    def named(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def only(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *map(only, KINDS), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
