"""Near-duplicate documents by an LSH forest of MinHash signatures.

1. Every text gives its set of word shingles, a MinHash signature and two sums that
   identify the set. Documents with equal sets are one class, named by its smallest id.
2. The forest: each tree lays the classes out in the sorted order of its own hashes of the signature.
   Classes with the same first hashes are a region; two of a region are candidates if
   their sketches (8 bits of each hash) don't exclude the wanted similarity by
   five standard errors. In a region of more than ``DENSE`` classes only the neighbours in the
   sorted order, those with the longest common prefixes, are compared at once. If they don't join the
   region into one set of candidates, its classes go on to the next level: further trees of their own,
   with longer prefixes and as many orders as these need (``LEVELS``). So the depth adapts to each region.
   What is still dense at the last level is cut without loss: by overlapping bands of
   set sizes (sets of similarity s differ in size by a factor of s at most), and large bands
   into blocks of which all pairs are compared, spread over tasks.
3. Components of the candidates are small sets that hold all similar pairs. In each
   the full shingle sets are compared, exactly, until no two documents of
   different components can be linked. A document inside the largest component
   need not be compared with others in it, so a group of n copies takes about n
   comparisons. Sets of candidates with too many shingles for one task are cut into
   blocks and all pairs of blocks are compared.
4. Components of the confirmed links name the groups.

A pair with similarity 0.8 shares a region of a level with probability 0.999997 or more (18 trees of depth 3, 45 of 6, 120 of 10), and
its sketches pass with probability 0.999996. A pair whose regions are all dense meets again in the next level, as both its classes go there; so at most
18 of a million such pairs are not compared, over all levels together, however many documents there are.
No partner, bucket or text is capped. Nothing about documents reaches the driver.

Defined results: a text with fewer words than a shingle is one shingle of all its
words; a text without words, or null, has an empty set and links with nothing. Rows
with the same id are one node; rows with a null id stand alone (component_id null,
kept). Other columns of the input take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.components import connected
from flowsift.llm.scratch import ship, written
from flowsift.llm.tokens import release
from flowsift.llm.vectors import chunks
from flowsift.llm.words import Words, mix64, pieces


class Level(NamedTuple):
    trees: int
    base: int  # hashes that the classes of a region share
    deep: int  # hashes by which a tree is sorted


LEVELS = (Level(18, 3, 6), Level(45, 6, 8), Level(120, 10, 12))
SKETCH = 48
#: Classes of a region above which only neighbours are compared; at the last level a task compares two blocks of at most about 4 * DENSE classes.
DENSE = 2048
#: Neighbours in the sorted order of a dense region.
NEIGHBOURS = 8
#: Shingles in one task's set of candidates.
BLOCK = 2_000_000
_rng = np.random.Generator(np.random.PCG64(20240613))
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def hash_functions(level: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and what is added first, for all hashes of a level's trees."""
    n = LEVELS[level].trees * LEVELS[level].deep
    rng = np.random.Generator(np.random.PCG64(20240614 + level))
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1, 2**63, n, dtype=np.uint64)


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts in a row, and where each text's begin (one more: the end)."""
    words = Words(texts)
    hashes, at = words.hashes(), words.doc_at
    found, bounds = [], np.zeros(len(at), np.int64)
    windows = max(len(hashes) - size + 1, 0)
    grams = np.zeros(windows, np.uint64)
    for k in range(size):
        grams += hashes[k : windows + k] * _PLACE[k]
    grams = mix64(grams)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if b - a >= size:
            own = np.unique(grams[a : b - size + 1])
        elif b > a:
            own = mix64((hashes[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            own = grams[:0]
        found.append(own)
        bounds[i + 1] = bounds[i] + len(own)
    return (np.concatenate(found) if found else grams[:0]), bounds


def shingles_by_slices(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As shingles; the words of only about 256 KB of texts are held at a time."""
    found, bounds = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for part in pieces(pa.record_batch({"text": texts}), "text", 1 << 18):
        own, at = shingles(part.column("text"), size)
        found.append(own)
        bounds.append(at[1:] + bounds[-1][-1])
    return np.concatenate(found), np.concatenate(bounds)


def signatures(sets: np.ndarray, at: np.ndarray, level: int = 0) -> np.ndarray:
    """Upper 32 bits of the least hash of each set for all hash functions; sets must not be empty."""
    multiply, add = hash_functions(level)
    out = np.empty((len(at) - 1, len(multiply)), np.uint32)
    for j, (m, c) in enumerate(zip(multiply, add, strict=True)):
        out[:, j] = np.minimum.reduceat((sets ^ c) * m, at[:-1]) >> np.uint64(32)
    return out


def _prints(docs: DataFrame, size: int, level: int = 0) -> DataFrame:
    """doc_id, n, k1, k2 (they identify the set), sig (null without words), by the hashes of a level."""
    name1, name2 = _PLACE[-2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 18):
                sets, at = shingles(part.column("text"), size)
                n = np.diff(at)
                full = np.flatnonzero(n)
                k1, k2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                sig: list[bytes | None] = [None] * len(n)
                if len(full):
                    begin = np.append(at[:-1][full], len(sets))
                    k1[full] = np.add.reduceat(mix64(sets ^ name1), begin[:-1])
                    k2[full] = np.add.reduceat(mix64(sets ^ name2), begin[:-1])
                    for i, s in zip(full.tolist(), signatures(sets, begin, level), strict=True):
                        sig[i] = s.tobytes()
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"), "n": pa.array(n), "k1": pa.array(k1.view(np.int64)),
                    "k2": pa.array(k2.view(np.int64)), "sig": pa.array(sig, pa.binary()),
                })
        release()

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, sig binary")


def _forest(level: int):
    trees, base, deep = LEVELS[level]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each tree: region, the hashes that sort it, size of the set, sketch, id."""
        step = (1 << 19) // (trees * deep)
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(-1, trees, deep)
                flat = sig.reshape(len(sig), -1)
                sketch = np.ascontiguousarray(flat[:, :: flat.shape[1] // SKETCH][:, :SKETCH].astype(np.uint8))
                for t in range(trees):
                    key = np.full(len(sig), t + 1, np.uint64)
                    for d in range(base):
                        key = mix64(key * np.uint64(31) + sig[:, t, d].astype(np.uint64))
                    # Big-endian, so that bytes sort as the hashes do.
                    rest = np.ascontiguousarray(sig[:, t, base:].astype(">u4"))
                    yield pa.record_batch({
                        "key": pa.array(key.view(np.int64)), "deep": _fixed(rest, 4 * (deep - base)), "n": part.column("n"),
                        "sketch": _fixed(sketch, SKETCH), "id": part.column("doc_id"),
                    })

    return run


def _fixed(rows: np.ndarray, width: int) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches again as tables of whole keys, with where each key begins (one more: the end)."""
    held: list[pa.RecordBatch] = []

    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows + 1, bool)
        new[0] = new[-1] = True
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:-1] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if len(held) > 1 and all(held[0].column(k)[0] == batch.column(k)[-1] for k in keys):
            continue  # still the one key
        table = pa.Table.from_batches(held)
        at = bounds(table)
        if len(at) > 2:
            yield table.slice(0, int(at[-2])), at[:-1]
            held = table.slice(int(at[-2])).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, bounds(table)


class _Union:
    """Links of one task, as pairs (id, smallest id seen with it)."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = z = self.up.get(y, y)
            x = z
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def batch(self) -> pa.RecordBatch:
        names = list(self.up)
        return pa.record_batch({"a": pa.array(names, pa.int64()), "b": pa.array([self.root(x) for x in names], pa.int64())})


def _agreeing(columns: np.ndarray, one: np.ndarray) -> np.ndarray:
    """In how many bytes each sketch (a column) agrees with one."""
    if columns.shape[1] < 512:
        return (columns == one[:, None]).sum(0)
    same = np.zeros(columns.shape[1], np.uint8)
    for column, byte in zip(columns, one, strict=True):
        same += column == byte
    return same


def _linked(sketch: np.ndarray, least: float) -> np.ndarray:
    """For each row the first row it is connected with through sketches that agree enough."""
    label = np.full(len(sketch), -1)
    rest, columns, left = np.arange(len(sketch)), np.ascontiguousarray(sketch.T), len(sketch)
    for name in range(len(sketch)):
        if label[name] >= 0:
            continue
        label[name] = name
        front, left = [name], left - 1
        while front and left:
            p = front.pop()
            if 2 * left < len(rest):
                rest = rest[label[rest] < 0]
                columns = np.ascontiguousarray(sketch[rest].T)
            near = rest[_agreeing(columns, sketch[p]) >= least]
            near = near[label[near] < 0]
            label[near] = name
            left -= len(near)
            front.extend(near.tolist())
    return label


def _least(threshold: float) -> float:
    """Bytes of two sketches that agree at least, at the wanted similarity, but for five standard errors."""
    return float(np.ceil((threshold - 5 * np.sqrt(threshold * (1 - threshold) / SKETCH)) * SKETCH))


def _prefix_neighbours(threshold: float):
    """Links in dense regions: each class and the next ones in the sorted order."""
    least = _least(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Union()
        for table in chunks(batches, 1 << 15):
            key, ids = table.column("key").to_numpy(), table.column("id").to_numpy()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            for step in range(1, NEIGHBOURS + 1):
                a = np.flatnonzero(key[:-step] == key[step:])
                a = a[(sketch[a] == sketch[a + step]).sum(1) >= least]
                for x, y in zip(ids[a].tolist(), ids[a + step].tolist(), strict=True):
                    links.link(x, y)
        yield links.batch()

    return run


def _neighbours(threshold: float):
    least = _least(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Union()
        for table, at in by_key(batches, ["key"]):
            ids = table.column("id").to_numpy()
            size = np.diff(at)
            many = np.flatnonzero(size > 1)
            if not len(many):
                continue
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            first = at[many[size[many] == 2]]
            near = (sketch[first] == sketch[first + 1]).sum(1) >= least
            for a, b in zip(ids[first[near]].tolist(), ids[first[near] + 1].tolist(), strict=True):
                links.link(a, b)
            for r in many[size[many] > 2]:
                a, b = int(at[r]), int(at[r + 1])
                own = ids[a:b].tolist()
                label = _linked(sketch[a:b], least).tolist()
                for x, y in zip(own, label, strict=True):
                    links.link(x, own[y])
        yield links.batch()
        release()

    return run


def _cut(rows: DataFrame, percent: int) -> DataFrame:
    """key, deep, sketch, id: dense regions in parts, so that every pair that may be similar shares a part."""
    # Similar sets are in the same band or in neighbouring ones; part b has the bands b and b - 1.
    width = max(float(np.log(100 / percent)), 0.01) * (1 + 1e-9)
    band = F.floor(F.log(F.col("n")) / width)
    banded = written(rows.select("key", F.explode(F.array(band, band + 1)).alias("band"), "deep", "sketch", "id"), "dense-bands")
    large = banded.groupBy("key", "band").agg(F.ceil(F.count("*") / (4 * DENSE)).cast("int").alias("blocks")).where("blocks > 2")
    large = written(large, "dense-blocks")
    dealt = banded.join(large, ["key", "band"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("blocks = 1 or other <> own")
    part = F.xxhash64("key", "band", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select(part.alias("key"), "deep", "sketch", "id")


def _candidates(texts: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links a, b whose components hold all pairs of classes that are similar."""
    threshold = percent / 100
    signed = classes.select(F.col("rep").alias("doc_id"), "n", "sig")
    found = None
    for level in range(len(LEVELS)):
        rows = signed.mapInArrow(_forest(level), "key long, deep binary, n long, sketch binary, id long")
        dense = written(rows.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > DENSE).select("key"), "dense")
        none = dense.isEmpty()
        sparse = rows if none else rows.join(dense, "key", "left_anti")
        links = _regions(sparse, threshold)
        found = links if found is None else found.unionByName(links)
        if none:
            return found
        crowd = written(rows.join(dense, "key"), "dense-rows")
        ordered = crowd.repartitionByRange("key", "deep", "id").sortWithinPartitions("key", "deep", "id")
        chains = ordered.select("key", "sketch", "id").mapInArrow(_prefix_neighbours(threshold), "a long, b long")
        joined = written(connected(found.unionByName(chains)), "joined")
        found = joined.select(F.col("node").alias("a"), F.col("root").alias("b"))
        # A region whose classes are one set of candidates has nothing more to find.
        named = crowd.join(joined, F.col("id") == F.col("node"), "left").select("key", F.coalesce("root", "id").alias("comp"))
        several = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
        open_ = written(several, "open-regions")
        if open_.isEmpty():
            return found
        crowd = crowd.join(open_, "key", "left_semi")
        if level + 1 < len(LEVELS):
            ids = written(crowd.select("id").distinct(), "open-classes")
            again = texts.join(ids, F.col("doc_id") == F.col("id"), "left_semi")
            # Rows with the same id and text are one.
            signed = _prints(again, size, level + 1).where("n > 0").groupBy("doc_id", "n", "k1", "k2").agg(F.min("sig").alias("sig"))
            signed = written(signed.select("doc_id", "n", "sig"), "deeper-prints")
    return found.unionByName(_regions(_cut(crowd, percent), threshold))


def _regions(rows: DataFrame, threshold: float) -> DataFrame:
    """Links between the classes of each region, all of which are compared."""
    ordered = rows.select("key", "deep", "sketch", "id").repartition("key").sortWithinPartitions("key", "deep", "id")
    return ordered.mapInArrow(_neighbours(threshold), "a long, b long")


def confirm(sets: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """Component (index of its first set) of each set, linking pairs whose similarity is at least percent / 100.

    A pivot is compared with all sets at once. Sets in the largest component are no
    pivots: whatever is outside it meets them as a pivot itself.
    """
    m = len(at) - 1
    label = np.arange(m)
    if m < 2:
        return label
    names, ids = np.unique(sets, return_inverse=True)
    size = np.diff(at)
    common = np.add.reduceat(np.bincount(ids)[ids], at[:-1]) / size
    order = np.argsort(-common, kind="stable")
    done = np.zeros(m, bool)
    flag = np.zeros(len(names), np.int64)
    while True:
        progress = False
        for p in order:
            if done[p]:
                continue
            if progress and label[p] == largest:  # noqa: F821
                continue
            own = ids[at[p] : at[p + 1]]
            flag[own] = 1
            both = np.add.reduceat(flag[ids], at[:-1])
            flag[own] = 0
            done[p] = True
            near = 100 * both >= percent * (size + size[p] - both)
            kinds = np.unique(label[near])
            if len(kinds) > 1:
                label[np.isin(label, kinds)] = kinds[0]
            if not progress or len(kinds) > 1:
                largest = np.bincount(label).argmax()
            progress = True
        if not progress or not (~done & (label != largest)).any():
            return label


def _confirmed(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Union()
        for table, at in by_key(batches, ["comp", "i", "j"]):
            ids = table.column("id").to_numpy()
            sets, begin = shingles_by_slices(table.column("text").combine_chunks(), size)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = begin[a : b + 1]
                label = confirm(sets[own[0] : own[-1]], own - own[0], percent)
                for x, y in zip(ids[a:b].tolist(), ids[a + label].tolist(), strict=True):
                    links.link(x, y)
            del sets
        yield links.batch()
        release()

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = written(_prints(texts, size), "prints")
    known = prints.where("n > 0 and doc_id is not null")
    classes = written(
        known.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig")), "classes"
    )
    near = _candidates(texts, classes, size, percent)
    roots = connected(near)
    members = roots.select(F.col("node").alias("id"), F.col("root").alias("comp")).unionByName(
        roots.select(F.col("root").alias("id"), F.col("root").alias("comp")).distinct()
    )
    members = written(members, "candidates")
    sized = members.join(known.select(F.col("doc_id").alias("id"), "n"), "id")
    blocks = sized.groupBy("comp").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    blocks = written(blocks, "blocks")
    cut = members.join(blocks, "comp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = written(
        cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .where("blocks = 1 or other <> own")
        .select("id", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")),
        "dealt",
    )
    # The candidates grow with the documents, so they are never broadcast.
    full = texts.where("doc_id is not null and text is not null").join(dealt.hint("merge"), F.col("doc_id") == F.col("id")).select("comp", "i", "j", "id", "text")
    links = full.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "id").mapInArrow(_confirmed(size, percent), "a long, b long")
    groups = connected(links)
    named = written(
        classes.drop("sig").join(groups, F.col("rep") == F.col("node"), "left")
        .select("n", "k1", "k2", F.coalesce("root", "rep").alias("component")), "named",
    )
    out = prints.drop("sig").join(named, ["n", "k1", "k2"], "left").withColumn(
        "component_id", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    )
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def op5(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2, percent=80)


def op5_sql(size: int = 2, percent: int = 80) -> str:
    return f"""
    WITH RECURSIVE words AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
      FROM documents),
    sets AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i : i + {size} - 1], ' '))) END AS s FROM words),
    classes AS (SELECT list_sort(s) AS s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY 1),
    items AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM classes),
    pairs AS (
      SELECT a.rep AS x, b.rep AS y FROM items a JOIN items b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
    links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
    reach AS (SELECT rep AS x, rep AS y FROM classes UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
    named AS (SELECT x AS rep, min(y) AS component FROM reach GROUP BY x)
    SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(n.component, s.doc_id) AS component_id, s.doc_id = coalesce(n.component, s.doc_id) AS kept
    FROM sets s LEFT JOIN classes c ON list_sort(s.s) = c.s LEFT JOIN named n ON n.rep = c.rep
    """
