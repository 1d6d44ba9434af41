"""Prefix trie of conversations: sorted turn sequences, their common prefixes, and range minima over these.

Turns become digests of 16 bytes when they are read; texts are never shuffled. Conversations
are range-sorted by their digests. A block of sorted rows (an Arrow batch) gets the lengths of
the common prefixes of neighbours and sparse tables of their minima. Every candidate
prefix, the first of its kind in the block, finds how far it reaches by
binary searches in the tables, each by itself: that interval is the node. Nodes are numbered row by
row, so a subtree is a run of numbers, and what is summed over it is a difference of two running sums.
Nodes that touch an end of their block may go on in the next one: these, at most two
for each depth and block, are joined by their digests. So no task holds more than a block, a prefix that
a third of all conversations share is one row per block, and no group is ever collected.

Positions inside a conversation are running counts over the parts of a range sort, so
a conversation id may hold any share of all rows. A row holds at most ``width``
turns: longer conversations are several rows, named by a digest of all turns before, and are
processed from the deepest level that two conversations share up to the first; what only one conversation
reaches is a plain path.

Defined results: a null role or text is empty; turns are ordered by number (nulls
first), then role, then digest; equal rows are turns of their own, one after another;
rows without conversation id take no part; an empty table has no nodes. Other
columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.llm.scratch import ship, written

WIDTH = 64
ROOT = "0|"
EMPTY = hashlib.sha256(b"").hexdigest()
BEFORE = (Window.unboundedPreceding, -1)


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """runs: conv_id, first (place of the turn, from 1), n (how often it is repeated), key, size; and convs: conv_id, total."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("key"),
        F.octet_length(text).cast("long").alias("size"),
    )
    rows = rows.groupBy("conv_id", "turn", "role", "key", "size").agg(F.count("*").alias("n"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]
    # A conversation over many parts counts its turns part by part.
    parts = written(rows.repartitionByRange(F.col("conv_id"), *order).withColumn("part", F.spark_partition_id()), "trie-turns")
    sums = written(parts.groupBy("part", "conv_id").agg(F.sum("n").alias("n")), "trie-parts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(*BEFORE)), F.lit(0))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("part", "conv_id").orderBy(*order).rowsBetween(*BEFORE)), F.lit(0))
    placed = parts.withColumn("within", within).join(sums.select("part", "conv_id", before.alias("before")), ["part", "conv_id"])
    runs = placed.select("conv_id", (F.col("before") + F.col("within") + 1).alias("first"), "n", "key", "size")
    return written(runs, "trie-runs"), written(sums.groupBy("conv_id").agg(F.sum("n").alias("total")), "trie-convs")


def with_shared_heads(runs: DataFrame, convs: DataFrame, every: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as conversation c - c % every does, with crc32(c) % (most + 1) of its turns at most."""
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).alias("head")
    named = convs.select("conv_id", "total", head, (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("total").alias("base_total"))
    plan = named.join(bases, "base", "left").select(
        "conv_id", "base", "head", (F.col("conv_id") == F.col("base")).alias("own"),
        F.least("head", F.coalesce("base_total", F.lit(0))).alias("taken"), F.col("total").alias("turns"),
    )
    length = F.when(F.col("own"), F.col("turns")).otherwise(F.col("taken") + F.greatest(F.col("turns") - F.col("head"), F.lit(0)))
    plan = written(plan.withColumn("total", length).drop("turns"), "trie-plan")
    last = F.col("first") + F.col("n") - 1
    start = F.when(F.col("own"), F.col("first")).otherwise(F.greatest("first", F.col("head") + 1))
    shift = F.when(F.col("own"), F.lit(0)).otherwise(F.col("taken") - F.col("head"))
    kept = runs.join(plan, "conv_id").where(last >= start)
    kept = kept.select("conv_id", (start + shift).alias("first"), (last - start + 1).alias("n"), "key", "size")
    heads = runs.where((F.col("conv_id") % every == 0) & (F.col("first") <= most)).withColumnRenamed("conv_id", "base")
    begun = heads.join(plan.where("not own").select("base", "conv_id", "head"), "base").where("first <= head")
    begun = begun.select("conv_id", "first", (F.least(last, F.col("head")) - F.col("first") + 1).alias("n"), "key", "size")
    return kept.unionByName(begun), plan.select("conv_id", "total")


def _running(rows: DataFrame, values: list[str], span: int = 4096) -> DataFrame:
    """Sums of the values over a conversation's earlier rows, in spans of ``span`` rows and over the spans before."""
    rows = rows.withColumn("span", F.floor(F.col("level") / span))
    whole = rows.groupBy("conv_id", "span").agg(*[F.sum(v).alias(v) for v in values])
    spans, inner = Window.partitionBy("conv_id").orderBy("span").rowsBetween(*BEFORE), Window.partitionBy("conv_id", "span").orderBy("level").rowsBetween(*BEFORE)
    zero = F.lit(0).cast("decimal(38,0)")
    offsets = whole.select("conv_id", "span", *[F.coalesce(F.sum(v).over(spans), zero).alias(f"{v}_offset") for v in values])
    rows = rows.select("*", *[F.coalesce(F.sum(v).over(inner), zero).alias(f"{v}_inner") for v in values]).join(offsets, ["conv_id", "span"])
    return rows.select("*", *[(F.col(f"{v}_inner") + F.col(f"{v}_offset")).cast("decimal(38,0)").alias(f"{v}_before") for v in values])


def _rows(runs: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """Rows of at most ``width`` turns: conv_id, level, chain (digest of the turns before), next, keys, sizes, more."""
    last = F.col("first") + F.col("n") - 1
    level = F.explode(F.sequence(F.floor((F.col("first") - 1) / width), F.floor((last - 1) / width)))
    cut = runs.select("*", level.alias("level"))
    start, stop = F.greatest("first", F.col("level") * width + 1), F.least(last, (F.col("level") + 1) * width)
    turns = cut.select("conv_id", "level", F.struct(start.alias("start"), (stop - start + 1).cast("int").alias("n"), "key", "size").alias("t"))
    grouped = turns.groupBy("conv_id", "level").agg(F.sort_array(F.collect_list("t")).alias("t"))  # at most width turns

    def copies(field: str) -> Column:
        return F.flatten(F.transform("t", lambda t: F.array_repeat(t[field], t["n"])))

    rows = grouped.select("conv_id", "level", copies("key").alias("keys"), copies("size").alias("sizes"))
    none = convs.where("total = 0").select(
        "conv_id", F.lit(0).cast("long").alias("level"), F.array().cast("array<binary>").alias("keys"), F.array().cast("array<bigint>").alias("sizes")
    )
    rows = rows.unionByName(none).join(convs, "conv_id")
    rows = written(rows.withColumn("more", F.col("total") > (F.col("level") + 1) * width), "trie-cut")
    columns = ["conv_id", "level", "chain", "next", "keys", "sizes", "more"]
    digest = F.md5(F.concat_ws(",", F.col("level").cast("string"), F.transform("keys", F.hex)))
    lanes = [F.conv(F.substring(digest, k, 15), 16, 10).cast("decimal(38,0)").alias(f"lane{k}") for k in (1, 17)]
    long = _running(rows.where(F.col("total") >= width).select("*", *lanes), ["lane1", "lane17"])

    def name(at: Column, *sums: Column) -> Column:
        return F.concat(at.cast("string"), F.lit("|"), F.concat_ws(":", *[s.cast("string") for s in sums]))

    chain = F.when(F.col("level") == 0, F.lit(ROOT)).otherwise(name(F.col("level"), F.col("lane1_before"), F.col("lane17_before")))
    after = name(F.col("level") + 1, *[F.col(f"{v}_before") + F.col(v) for v in ("lane1", "lane17")])
    long = long.withColumn("chain", chain).withColumn("next", F.when(F.size("keys") == width, after))
    short = rows.where(F.col("total") < width).withColumn("chain", F.lit(ROOT)).withColumn("next", F.lit(None).cast("string"))
    return written(long.select(*columns).unionByName(short.select(*columns)), "trie-rows")


class Minima:
    """A sparse table: minima of all runs whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        while 2 << (len(self.tables) - 1) <= len(values):
            last, step = self.tables[-1], 1 << (len(self.tables) - 1)
            self.tables.append(np.minimum(last[:-step], last[step:]))
        self.size = len(values)

    def right(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place up to which all values after ``start`` are at least ``least``."""
        at = start.copy()
        for j in range(len(self.tables) - 1, -1, -1):
            goes = at + (1 << j) < self.size
            goes[goes] = self.tables[j][at[goes] + 1] >= least[goes]
            at[goes] += 1 << j
        return at

    def left(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from which all values up to ``start`` but its own are at least ``least``."""
        at = start.copy()
        for j in range(len(self.tables) - 1, -1, -1):
            goes = at - (1 << j) >= 0
            goes[goes] = self.tables[j][at[goes] - (1 << j) + 1] >= least[goes]
            at[goes] -= 1 << j
        return at

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        j = np.frexp((last - first + 1).astype(float))[1] - 1
        out = np.empty(len(first), self.tables[0].dtype)
        for k in np.unique(j):
            use = j == k
            table = self.tables[k]
            out[use] = np.minimum(table[first[use]], table[last[use] - (1 << int(k)) + 1])
        return out


def common_prefixes(keys: np.ndarray, sizes: np.ndarray, same_chain: np.ndarray) -> np.ndarray:
    """Equal turns at the start of each row and the row before; -1 for the first and after another chain."""
    out = np.full(len(sizes), -1, np.int64)
    at = np.cumsum(sizes) - sizes
    rows = np.flatnonzero(same_chain[1:]) + 1
    both = np.minimum(sizes[rows - 1], sizes[rows])
    out[rows] = both
    many = rows[both > 0]
    both = both[both > 0]
    if len(many):
        ends = np.cumsum(both)
        step = np.arange(int(ends[-1])) - np.repeat(ends - both, both)
        equal = (keys[np.repeat(at[many - 1], both) + step] == keys[np.repeat(at[many], both) + step]).all(axis=1)
        out[many] = np.minimum.reduceat(np.where(equal, np.repeat(both, both), step), ends - both)
    return out


NODES = (
    "kind int, node_id string, parent_id string, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, size long, ext_children long, ext_leaves long, ext_saved long, "
    "path array<string>, end_ids array<bigint>"
)
NODE, GROUP, PART = 0, 1, 2


def _block(batch: pa.RecordBatch, level: int, width: int) -> pa.RecordBatch:
    """The nodes of a block of sorted rows: whole ones, groups of the level's chains, and parts of nodes at its ends."""
    m = batch.num_rows
    chains, nexts = batch.column("chain").to_pylist(), batch.column("next").to_pylist()
    convs = batch.column("conv_id").to_numpy()
    more = batch.column("more").to_numpy(zero_copy_only=False)
    ext = [batch.column(f"ext_{c}").to_numpy() for c in ("children", "leaves", "saved")]
    lists = batch.column("keys")
    long = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    raw = b"".join(lists.flatten().to_pylist())
    keys = np.frombuffer(raw, "<u8").reshape(-1, 2)
    sizes = batch.column("sizes").flatten().to_numpy()
    first_key = np.cumsum(long) - long
    same = np.array([False, *(a == b for a, b in zip(chains[1:], chains[:-1], strict=True))])
    prefix = common_prefixes(keys, long, same)
    minima, smallest = Minima(prefix), Minima(convs)
    # Candidates: of every row the prefixes that the row before does not have.
    own = long - prefix
    offset = np.cumsum(own) - own
    row = np.repeat(np.arange(m), own)
    depth = np.arange(len(row)) - offset[row] + prefix[row] + 1
    last = minima.right(row, depth)
    inner = depth > 0
    parent = np.full(len(row), -1)
    above = minima.left(row[inner], depth[inner] - 1)
    parent[inner] = offset[above] + depth[inner] - 1 - prefix[above] - 1
    n, conv = last - row + 1, smallest.of(row, last)
    cut = (row == 0) | (last == m - 1)
    whole = ~cut
    full = depth == width
    more_children, more_leaves, more_saved = (np.where(full & more[last], x[last], 0) for x in ext)
    children = np.bincount(parent[inner & whole], minlength=len(row)) + np.where(whole, more_children, 0)
    size = np.zeros(len(row), np.int64)
    size[inner] = sizes[first_key[row[inner]] + depth[inner] - 1]
    leaf = np.where(whole, (children == 0) + more_leaves, 0)
    saved = np.where(whole, (n - 1) * size + more_saved, 0)
    stop = offset[last] + own[last]  # a subtree's nodes are numbered from the node itself to its last row's end

    def subtree(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(x)])
        return sums[stop] - sums[np.arange(len(x))]

    leaves, total = subtree(leaf), subtree(saved)
    # Conversations that end in a node are its first rows.
    again = same & (prefix == long) & ~more
    again[1:] &= long[1:] == long[:-1]
    ended = np.flatnonzero(~again)
    run_end = np.append(ended[1:], m)[np.searchsorted(ended, np.arange(m), "right") - 1]
    ends_here = (depth == long[row]) & ~more[row]

    def node_id(i: int) -> str:
        r, d = int(row[i]), int(depth[i])
        if d == 0:
            return chains[r]
        if d == width:
            return nexts[int(last[i])]
        at = int(first_key[r]) * 16
        return hashlib.md5(f"{chains[r]}|".encode() + raw[at : at + 16 * d]).hexdigest()

    ids: dict[int, str] = {}

    def known(i: int) -> str:
        if i not in ids:
            ids[i] = node_id(i)
        return ids[i]

    def path(i: int) -> list[str]:
        out = []
        while i >= 0:
            out.append(known(i))
            i = int(parent[i])
        return out[::-1]

    kind = np.where(cut, PART, np.where((depth == 0) & (level > 0), GROUP, NODE))
    # A whole node's parent may be a part, or belong to the level before.
    far = inner & whole & (cut[parent] | ((level > 0) & (depth == 1)))
    near = inner & whole & ~far
    listed = [i for i in np.flatnonzero(cut | far | (whole & full) | (kind == GROUP)).tolist()]
    names: list[str | None] = [None] * len(row)
    parents: list[str | None] = [None] * len(row)
    paths: list[list[str] | None] = [None] * len(row)
    for i in listed:
        if cut[i] or full[i] or kind[i] == GROUP:
            names[i] = known(i)
        if cut[i]:
            paths[i] = path(i)
        elif far[i]:
            parents[i] = known(int(parent[i]))
    digests, end_ids = [EMPTY] * len(row), [None] * len(row)
    for i in np.flatnonzero(ends_here).tolist():
        own_ids = convs[row[i] : run_end[row[i]]].tolist()
        if cut[i]:
            end_ids[i] = own_ids
        else:
            digests[i] = hashlib.sha256(",".join(map(str, own_ids)).encode()).hexdigest()
    beside = np.where(near, conv[np.maximum(parent, 0)], 0)
    return pa.record_batch([
        pa.array(kind, pa.int32()), pa.array(names, pa.string()), pa.array(parents, pa.string()), pa.array(depth + level * width),
        pa.array(conv), pa.array(beside, mask=~near), pa.array(n), pa.array(children), pa.array(leaves), pa.array(total),
        pa.array(digests, pa.string()), pa.array(size), pa.array(more_children), pa.array(more_leaves), pa.array(more_saved),
        pa.array(paths, pa.list_(pa.string())), pa.array(end_ids, pa.list_(pa.int64())),
    ], names=[c.split()[0] for c in NODES.split(", ")])


def _digests_of_parts(parts: DataFrame) -> DataFrame:
    """node_id, ends: the digest of ids that lie in several blocks, read in order; a node's ids are never held together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, begun = None, hashlib.sha256(), False
        for batch in batches:
            out: list[tuple[str, str]] = []
            for name, ids in zip(batch.column("node_id").to_pylist(), batch.column("end_ids").to_pylist(), strict=True):
                if name != node:
                    if node is not None:
                        out.append((node, digest.hexdigest()))
                    node, digest, begun = name, hashlib.sha256(), False
                digest.update((("," if begun else "") + ",".join(map(str, ids))).encode())
                begun = True
            yield pa.record_batch({"node_id": pa.array([x for x, _ in out], pa.string()), "ends": pa.array([x for _, x in out], pa.string())})
        if node is not None:
            yield pa.record_batch({"node_id": pa.array([node]), "ends": pa.array([digest.hexdigest()])})

    listed = parts.where(F.size("end_ids") > 0).select("node_id", "end_ids")
    return listed.repartition("node_id").sortWithinPartitions("node_id", F.col("end_ids")[0]).mapInArrow(work, "node_id string, ends string")


def _merged(parts: DataFrame) -> DataFrame:
    """Nodes that reach over the ends of blocks, from their parts."""
    joined = written(
        parts.groupBy("node_id").agg(
            F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
            *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")],
            *[F.max(c).alias(c) for c in ("size", "ext_children", "ext_leaves", "ext_saved")], F.min("path").alias("path"),
        ), "trie-merged")
    above = F.when(F.size("path") > 1, F.element_at("path", -2)).alias("parent_id")
    joined = joined.select("*", above)
    kids = joined.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("kids"))
    children = F.col("n_children") + F.coalesce("kids", F.lit(0)) + F.col("ext_children")
    joined = joined.join(kids, "node_id", "left").withColumn("n_children", children).drop("kids")
    joined = written(joined.select(
        "*", ((F.col("n_convs") - 1) * F.col("size") + F.col("ext_saved")).alias("own_saved"),
        (F.when(F.col("n_children") == 0, 1).otherwise(0) + F.col("ext_leaves")).alias("own_leaves"),
    ), "trie-whole")
    below = joined.select(F.explode("path").alias("node_id"), "own_saved", "own_leaves").groupBy("node_id").agg(
        F.sum("own_saved").alias("below_saved"), F.sum("own_leaves").alias("below_leaves")
    )
    ends = _digests_of_parts(parts)
    out = joined.join(below, "node_id").join(ends, "node_id", "left")
    return out.select(
        "node_id", "parent_id", "depth", "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("n_leaves") + F.col("below_leaves")).alias("n_leaves"), (F.col("saved_tokens") + F.col("below_saved")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )


COLUMNS = [
    "node_id", "parent_id", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
]


def _alone(rows: DataFrame, first_level: int, width: int) -> DataFrame:
    """Nodes of levels that no two conversations share: paths without branches."""
    # Row-wise work only: every turn is a node with one member.
    node = F.explode(F.sequence(F.lit(1), F.size("keys")))
    out = rows.where(F.col("level") >= first_level).select("conv_id", "level", "chain", "more", F.size("keys").alias("n"), node.alias("at"))
    ends = (F.col("at") == F.col("n")) & ~F.col("more")
    top = (F.col("at") == 1) & (F.col("level") == first_level)
    return out.select(
        F.lit(None).cast("string").alias("node_id"), F.when(top, F.col("chain")).alias("parent_id"),
        (F.col("level") * width + F.col("at")).alias("depth"), "conv_id", F.when(~top, F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), F.when(ends, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(ends, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(EMPTY).alias("ends_sha256"),
    )


def prefix_trie(runs: DataFrame, convs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ship(runs.sparkSession)
    rows = _rows(runs, convs, width)
    shared = rows.where("level > 0").groupBy("level", "chain").agg(F.count("*").alias("n")).where("n > 1").agg(F.max("level")).first()[0] or 0
    zero = F.lit(0).cast("long")
    levels, groups = [], None
    for level in range(shared, -1, -1):
        here = rows.where(F.col("level") == level).select("conv_id", "chain", "next", "keys", "sizes", "more")
        if groups is None:  # below the last shared level every chain goes on alone
            one = F.when(F.col("more"), F.lit(1)).otherwise(0).cast("long")
            here = here.select("*", one.alias("ext_children"), one.alias("ext_leaves"), zero.alias("ext_saved"))
        else:
            here = here.join(groups, here["next"] == groups["group_id"], "left").select(
                *here.columns, *[F.coalesce(c, zero).alias(c) for c in ("ext_children", "ext_leaves", "ext_saved")]
            )
        order = ["chain", "keys", "more", "conv_id"]
        blocks = here.repartitionByRange(*order).sortWithinPartitions(*order)
        nodes = written(blocks.mapInArrow(_each_block(level, width), NODES), "trie-nodes")
        merged = written(_merged(nodes.where(F.col("kind") == PART)), "trie-parts")
        whole = nodes.where(F.col("kind") == NODE).select(*COLUMNS)
        if level:
            top = merged.where(F.col("depth") == level * width).select(*COLUMNS)
            groups = nodes.where(F.col("kind") == GROUP).select(*COLUMNS).unionByName(top).select(
                F.col("node_id").alias("group_id"), F.col("n_children").alias("ext_children"),
                F.col("n_leaves").alias("ext_leaves"), F.col("saved_tokens").alias("ext_saved"),
            )
            merged = merged.where(F.col("depth") > level * width)
        levels += [whole, merged]
    everything = reduce(DataFrame.unionByName, [*levels, _alone(rows, shared + 1, width)])
    root = convs.agg(F.min("conv_id")).first()[0]
    names = written(everything.where("node_id is not null").select(F.col("node_id").alias("parent_id"), F.col("conv_id").alias("parent")), "trie-names")
    near = everything.where(f"parent_id is null or parent_id = '{ROOT}'")
    near = near.withColumn("parent_conv_id", F.when(F.col("parent_id") == ROOT, F.lit(root).cast("long")).otherwise(F.col("parent_conv_id")))
    far = everything.where(f"parent_id <> '{ROOT}'").join(names, "parent_id").withColumn("parent_conv_id", F.col("parent"))
    final = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return near.select(*final).unionByName(far.select(*final))


def _each_block(level: int, width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _block(batch, level, width)

    return work


def op12(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(*with_shared_heads(*ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP12_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS key
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT conv_id, key, octet_length(encode(text)) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, key) AS i FROM turns),
ids AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, count(*) AS n FROM turns GROUP BY ALL),
plan AS (
  SELECT conv_id, n, conv_id - conv_id % 5 AS base,
    xor(list_reduce([4294967295] || list_transform(range(1, length(s) + 1), lambda k: ascii(substr(s, k, 1))::BIGINT),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295) % 9 AS h
  FROM ids),
built AS (
  SELECT p.conv_id, 0 AS own, i, key, size FROM plan p JOIN placed t ON t.conv_id = p.base AND i <= h
  UNION ALL
  SELECT p.conv_id, 1, i, key, size FROM plan p JOIN placed t ON t.conv_id = p.conv_id AND i > h),
steps AS (
  SELECT conv_id, size, row_number() OVER w AS depth, string_agg(key, '') OVER w AS path FROM built
  WINDOW w AS (PARTITION BY conv_id ORDER BY own, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lengths AS (SELECT conv_id, coalesce(max(depth), 0) AS total FROM plan LEFT JOIN steps USING (conv_id) GROUP BY conv_id),
members AS (
  SELECT conv_id, depth, path, size, total FROM steps JOIN lengths USING (conv_id)
  UNION ALL SELECT conv_id, 0, '', 0, total FROM lengths),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS own,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (total = depth), '')) AS ends_sha256
  FROM members GROUP BY path, depth),
kids AS (SELECT left(path, 32 * (depth - 1)::INT) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
grown AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (path)),
above AS (SELECT left(path, 32 * a::INT) AS path, own, n_children FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM grown)),
sums AS (SELECT path, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM above GROUP BY path)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, g.n_convs, CAST(g.n_children AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, g.ends_sha256
FROM grown g JOIN sums s USING (path) LEFT JOIN nodes p ON g.depth > 0 AND p.path = left(g.path, 32 * (g.depth - 1)::INT)
"""
