"""Locality-sensitive index over packed codes and exact kNN among bucket-mates.

A hash function is the parity of some bits of the code; a table's key packs the
parities of all its functions. Keys are linear: ``key(a) ^ key(b) = key(a ^ b)``.
Two things follow and shape the plan:

* the keys of all tables are a XOR of eight byte lookups, kept as a few packed
  ``w*`` columns beside each code;
* a pair that meets in several tables is counted only in the first of them,
  which the two rows decide from their own ``w*`` columns. Bucket-mates are
  thus distinct without shuffling pairs.

What leaves the join is a distance histogram per query (at most 65 rows),
summed map-side before it is shuffled.

Every table carries a ``run`` column, so several models (seeds) go through one
job.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowsift.functions.held import hold
from flowsift.functions.numeric import hamming, seeded_key
from flowsift.functions.runs import attach_run
from flowsift.operators.sampling import sample_n
from flowsift.schema import LSH_V1, LSH_V2, LshSpec

if TYPE_CHECKING:
    import pyarrow as pa

# Index rows (a code in a table, about 100 bytes) that may be broadcast.
BROADCAST_INDEX_ROWS = 1_000_000
# Every further round of a search that may end early looks at so many times the codes.
ROUND_STEP = 8
# A bucket with more codes than this is split over tasks.
HOT_BUCKET_CODES = 20_000
# Query codes of a hot bucket are spread over this many groups.
QUERY_SPREAD = 8
# Index and query rows that a task compares bucket by bucket, and the pairs it looks at together.
BLOCK_ROWS = 500_000
TILE_PAIRS = 1 << 16
# Training flows whose codes one partition of a cached index may hold.
CODE_PARTITION_ROWS = 50_000


class HashFamily:
    """Bit masks of a hash family: ``masks[table][function]``."""

    def __init__(self, masks: list[list[int]], code_bits: int):
        self.masks, self.code_bits = masks, code_bits
        self.tables, self.functions = len(masks), len(masks[0])
        self.per_word = 63 // self.functions
        self.word_count = -(-self.tables // self.per_word)

    @classmethod
    def draw(cls, seed: int, spec: LshSpec = LSH_V2) -> "HashFamily":
        """Draw a family with the legacy numpy generator, reproducible from the seed."""
        rng = np.random.RandomState(seed)
        bits, third = spec.code_bits, spec.tables // 3

        def window(width: int) -> range:
            start = rng.randint(0, max(1, bits - width))
            return range(start, min(start + width, bits))

        def positions(table: int):
            if spec.version == "v1":
                return rng.choice(bits, min(bits // 4, 16), replace=False)
            if table < third:
                return window(25)
            if table < 2 * third:
                return window(40)
            return rng.choice(bits, min(bits // 2, 30), replace=False)

        masks = [
            [sum(1 << int(p) for p in positions(t)) for _ in range(spec.functions)]
            for t in range(spec.tables)
        ]
        return cls(masks, bits)

    def byte_tables(self, word: int) -> list[list[int]]:
        """For each byte of the code, the 256 contributions to one packed word."""
        effect = [0] * 64
        for slot in range(self.per_word):
            table = word * self.per_word + slot
            if table >= self.tables:
                break
            for f, mask in enumerate(self.masks[table]):
                for bit in range(64):
                    if mask >> bit & 1:
                        effect[bit] ^= 1 << (slot * self.functions + f)
        out = []
        for byte in range(8):
            row = [0] * 256
            for value in range(1, 256):
                low = value & -value
                row[value] = row[value ^ low] ^ effect[8 * byte + low.bit_length() - 1]
            out.append(row)
        return out


def hash_codes(codes: DataFrame, families: dict[int, HashFamily], code: str = "embedding") -> DataFrame:
    """Add the packed key words; each ``run`` has its own family.

    The byte tables of a family are about 100 KB.
    """
    tables = {
        r: {f"__b{w}_{j}": row for w in range(f.word_count) for j, row in enumerate(f.byte_tables(w))}
        for r, f in families.items()
    }
    words = []
    for w in range(next(iter(families.values())).word_count):
        total = None
        for j in range(8):
            value = F.shiftrightunsigned(F.col(code), 8 * j).bitwiseAND(F.lit(255).cast("bigint")).cast("int")
            part = F.get(F.col(f"__b{w}_{j}"), value)
            total = part if total is None else total.bitwiseXOR(part)
        words.append(total.alias(f"w{w}"))
    kinds = {name: "array<bigint>" for name in next(iter(tables.values()))}
    return attach_run(codes, tables, kinds).select(*codes.columns, *words)


def word_names(spec: LshSpec) -> list[str]:
    return [f"w{i}" for i in range(-(-spec.tables // (63 // spec.functions)))]


def table_key(words: list[Column], table: int, spec: LshSpec) -> Column:
    """Key of one table out of the packed words."""
    per_word = 63 // spec.functions
    shift = spec.functions * (table % per_word)
    mask = F.lit((1 << spec.functions) - 1).cast("bigint")
    return F.shiftright(words[table // per_word], shift).bitwiseAND(mask).cast("int")


def explode_keys(hashed: DataFrame, spec: LshSpec) -> DataFrame:
    """One row per code and table: adds ``table_idx`` and ``hash_key``."""
    words = [F.col(w) for w in word_names(spec)]
    keys = F.array(*[table_key(words, t, spec) for t in range(spec.tables)])
    return hashed.select("*", F.posexplode(keys).alias("table_idx", "hash_key"))


def distinct_codes(codes: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """One row per code: number of flows and first position."""
    return codes.groupBy(*by, "embedding").agg(F.count("*").alias("n_flows"), F.min("id").alias("first_pos"))


def distance_sample(codes: DataFrame, seed: int, spec: LshSpec) -> DataFrame:
    """The seeded code sample for the distance statistics, numbered from 0."""
    return number_sample(sample_n(codes, spec.sample, seed), F.lit(seed), spec)


def number_sample(codes: DataFrame, seed: Column, spec: LshSpec) -> DataFrame:
    """Number the codes of each run in seeded order and keep the sample size.

    For tables that hold a sample of fixed size per run already.
    """
    order = Window.partitionBy("run").orderBy(seeded_key(seed, F.col("id")), "id")
    numbered = codes.select("run", "embedding", (F.row_number().over(order) - 1).alias("rn"))
    return numbered.where(F.col("rn") < spec.sample)


def distance_stats(sample: DataFrame, spec: LshSpec) -> DataFrame:
    """Mean, population std and percentiles of band distances in the sample, per run.

    Row i (one of the first ``anchors``) is compared with the next ``band`` rows:
    a window over a sample of fixed size.
    """
    order = Window.partitionBy("run").orderBy("rn")
    later = F.array(*[F.lead("embedding", j).over(order) for j in range(1, spec.band + 1)])
    pairs = sample.select("run", "rn", "embedding", later.alias("later"))
    near = F.when(F.col("rn") < spec.anchors, F.filter("later", lambda c: c.isNotNull())).otherwise(
        F.array().cast("array<bigint>")
    )
    distances = pairs.select("run", F.explode_outer(near).alias("other"), "embedding").select(
        "run", hamming(F.col("embedding"), F.col("other")).alias("d")
    )
    points = [0.10, 0.25, 0.50, 0.75, 0.90]
    return distances.groupBy("run").agg(
        F.coalesce(F.avg("d"), F.lit(spec.default_mean)).alias("mean"),
        F.coalesce(F.stddev_pop("d"), F.lit(spec.default_std)).alias("std"),
        # Distances are whole numbers up to 64, so the exact percentile holds at most 65 values.
        F.coalesce(F.percentile("d", points), F.array(*[F.lit(p) for p in spec.default_percentiles])).alias("p"),
    ).select("run", "mean", "std", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(["p10", "p25", "p50", "p75", "p90"])])


def with_threshold(stats: DataFrame, spec: LshSpec) -> DataFrame:
    """Add the adaptive threshold: v2 max(mean - 2 std, p25), v1 mean + 2 std."""
    mean, std = F.col("mean"), F.col("std")
    if spec.version == "v1":
        return stats.withColumn("threshold", mean + 2 * std)
    return stats.withColumn("threshold", F.greatest(mean - 2 * std, F.col("p25")))


@dataclass
class LshModel:
    """Index of normal codes plus small metadata for scoring.

    ``codes``: run, embedding, n_flows, first_pos, w* of every distinct code; this is what is cached.
    ``index``: the same with a row per table: table_idx, hash_key.
    ``stats``: one row per run. ``probes``: first keys per run and table.
    ``hot``: buckets split over tasks, with their number of parts.
    """

    spec: LshSpec
    families: dict[int, HashFamily]
    codes: DataFrame
    index_rows: int
    stats: list[Row]
    probes: list[Row] = field(default_factory=list)
    hot: list[Row] = field(default_factory=list)

    @property
    def spark(self) -> SparkSession:
        return self.codes.sparkSession

    @property
    def index(self) -> DataFrame:
        return explode_keys(self.codes, self.spec)

    def release(self) -> None:
        """Drop the cached codes."""
        self.codes.unpersist()

    def with_stats(self, df: DataFrame) -> DataFrame:
        """Add the statistics of each row's run."""
        names = ("mean", "std", "p10", "p25", "p50", "p75", "p90", "threshold")
        rows = {r["run"]: {n: float(r[n]) for n in names} for r in self.stats}
        return attach_run(df, rows, {n: "double" for n in names})

    def hash(self, codes: DataFrame) -> DataFrame:
        """Packed words for query codes of all runs."""
        return hash_codes(codes, self.families)

    def save(self, path: str) -> None:
        """Index as Parquet, laid out by bucket; metadata as one JSON row."""
        (self.index.repartition("run", "table_idx", "hash_key")
         .sortWithinPartitions("run", "table_idx", "hash_key")
         .write.mode("overwrite").parquet(f"{path}/index"))
        meta = {
            "version": self.spec.version,
            "families": {str(r): [[str(m) for m in t] for t in f.masks] for r, f in self.families.items()},
            "stats": [r.asDict() for r in self.stats],
            "probes": [r.asDict() for r in self.probes],
            "hot": [r.asDict() for r in self.hot],
        }
        self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "LshModel":
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        spec = LSH_V1 if meta["version"] == "v1" else LSH_V2
        families = {int(r): HashFamily([[int(m) for m in t] for t in masks], spec.code_bits)
                    for r, masks in meta["families"].items()}
        index = spark.read.parquet(f"{path}/index")
        codes = index.where("table_idx = 0").drop("table_idx", "hash_key")  # every code is in every table
        rows = {k: [Row(**r) for r in meta[k]] for k in ("stats", "probes", "hot")}
        return cls(spec, families, codes, index.count(), **rows)


def build_index(codes: DataFrame, families: dict[int, HashFamily], spec: LshSpec) -> DataFrame:
    """Distinct codes in every table: run, table_idx, hash_key, embedding, ..."""
    return explode_keys(index_codes(codes, families), spec)


def index_codes(codes: DataFrame, families: dict[int, HashFamily]) -> DataFrame:
    """Distinct codes with their packed keys: what a model keeps, a row per code."""
    return hash_codes(distinct_codes(codes), families)


def finish_model(
    codes: DataFrame, families: dict[int, HashFamily], stats: DataFrame, spec: LshSpec
) -> LshModel:
    """Collect the metadata of index codes that the caller has cached (statistics, probes, hot buckets)."""
    index = explode_keys(codes, spec)
    buckets = index.groupBy("run", "table_idx", "hash_key").agg(
        F.count("*").alias("codes"), F.min("first_pos").alias("first_pos")
    ).persist()
    sizes = buckets.agg(F.sum("codes").alias("rows")).first()
    index_rows = sizes["rows"] or 0
    hot: list[Row] = []
    if index_rows > BROADCAST_INDEX_ROWS:
        # At most 10,000 buckets can hold a ten-thousandth of the index each.
        large = max(HOT_BUCKET_CODES, index_rows // 10_000)
        hot = (
            buckets.where(F.col("codes") > large)
            .select("run", "table_idx", "hash_key", F.ceil(F.col("codes") / large).cast("int").alias("parts"))
            .collect()
        )
    probes: list[Row] = []
    if spec.probe_tables:
        order = Window.partitionBy("run", "table_idx").orderBy("first_pos", "hash_key")
        # Keys per table are at most 2^functions; the rank limit is applied before the shuffle.
        probes = (
            buckets.where(F.col("table_idx") < spec.probe_tables)
            .withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= spec.probe_keys)
            .groupBy("run", "table_idx")
            .agg(F.sort_array(F.collect_list("hash_key")).alias("keys"))
            .collect()
        )
    buckets.unpersist()
    found = with_threshold(stats, spec).collect()
    if not found:  # no training codes at all: the fixed statistics
        names = ("run", "mean", "std", "p10", "p25", "p50", "p75", "p90")
        default = [(r, spec.default_mean, spec.default_std, *spec.default_percentiles) for r in families]
        schema = ", ".join(f"{n} {'int' if n == 'run' else 'double'}" for n in names)
        found = with_threshold(index.sparkSession.createDataFrame(default, schema), spec).collect()
    return LshModel(spec, families, codes, index_rows, found, probes, hot)


def fit_lsh(codes: DataFrame, seed: int = 42, spec: LshSpec = LSH_V2, family: HashFamily | None = None) -> LshModel:
    """Index ``(id, embedding)`` of normal flows under one seed."""
    families = {0: family or HashFamily.draw(seed, spec)}
    tagged = codes.select(F.lit(0).alias("run"), "id", "embedding").persist()
    stats = distance_stats(distance_sample(tagged, seed, spec), spec)
    # Every search reads all partitions of the cached codes, so there are no more than the flows call for.
    spark = codes.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-tagged.count() // CODE_PARTITION_ROWS))
    kept = index_codes(tagged, families).coalesce(min(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    model = finish_model(kept.persist(), families, stats, spec)
    tagged.unpersist()
    return model


# ---------------------------------------------------------------- candidates


def _meet(model: LshModel, queries: DataFrame, index: DataFrame, index_rows: int, few: bool = False) -> DataFrame:
    """Join query rows with index rows of the same bucket.

    A small index is broadcast (its size is known), and so are ``few`` queries. Otherwise both are shuffled;
    hot buckets are cut into parts by code on the index side and into
    groups by code on the query side, so every cell stays small.
    """
    on = ["run", "table_idx", "hash_key"]
    words = word_names(model.spec)
    left = queries.select(*on, F.col("embedding").alias("query"), *[F.col(w).alias(f"q_{w}") for w in words])
    extra = [c for c in index.columns if c == "probe_bits"]
    right = index.select(*on, F.col("embedding").alias("code"), *[F.col(w).alias(f"c_{w}") for w in words], *extra)
    if index_rows <= BROADCAST_INDEX_ROWS:
        return left.join(F.broadcast(right), on)
    if few:
        return F.broadcast(left).join(right, on)
    left, right, on = _split_hot(model, left, right)
    return left.join(right, on)


def _split_hot(model: LshModel, left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the cells of hot buckets, and the columns on which they meet."""
    on = ["run", "table_idx", "hash_key"]
    if model.hot:
        hot = model.spark.createDataFrame(model.hot, "run int, table_idx int, hash_key int, parts int")
        hot = F.broadcast(hot)
        every_part = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
        group = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("query"), F.lit(QUERY_SPREAD))).cast("int")
        left = (
            left.join(hot, on, "left")
            .select(*left.columns, group.alias("spread"), F.explode(every_part).alias("part"))
        )
        part = F.coalesce(F.pmod(F.xxhash64("code"), F.col("parts")), F.lit(0)).cast("int")
        groups = F.sequence(F.lit(0), F.when(F.col("parts").isNull(), 0).otherwise(QUERY_SPREAD - 1))
        right = (
            right.join(hot, on, "left")
            .select(*right.columns, part.alias("part"), F.explode(groups).alias("spread"))
        )
        on = [*on, "part", "spread"]
    return left, right, on


def _pair_keys(spec: LshSpec) -> tuple[list[Column], list[Column]]:
    words = word_names(spec)
    return [F.col(f"q_{w}") for w in words], [F.col(f"c_{w}") for w in words]


def bucket_pairs(model: LshModel, queries: DataFrame, few: bool = False, one_in: int = 1) -> DataFrame:
    """``(run, query, code)`` of all bucket-mates, each pair once; with ``one_in``, of a share of the codes."""
    spec = model.spec
    codes = model.codes if one_in == 1 else model.codes.where(F.pmod(F.xxhash64("embedding"), F.lit(one_in)) == 0)
    rows = -(-model.index_rows // one_in)
    met = _meet(model, explode_keys(queries, spec), explode_keys(codes, spec), rows, few)
    q, c = _pair_keys(spec)
    crossed = [a.bitwiseXOR(b) for a, b in zip(q, c)]
    first = F.lit(True)
    for t in range(spec.tables - 1):
        first = first & ((F.col("table_idx") <= t) | (table_key(crossed, t, spec) != 0))
    return met.where(first).select("run", "query", "code")


def probe_pairs(model: LshModel, queries: DataFrame, few: bool = False) -> DataFrame:
    """``(run, query, code)`` from near keys, for queries without bucket-mates.

    Only the first keys (by position) of the first tables are looked at; a key
    within ``probe_bits`` differing bits counts as near.
    """
    spec = model.spec
    first_keys = {r: {f"__keys{t}": [] for t in range(spec.probe_tables)} for r in model.families}
    for row in model.probes:
        first_keys[row["run"]][f"__keys{row['table_idx']}"] = list(row["keys"])
    kinds = {f"__keys{t}": "array<int>" for t in range(spec.probe_tables)}
    words = [F.col(w) for w in word_names(spec)]

    def close(t: int) -> Column:
        """Bucket references of table t whose key is near the query's own key."""
        own = table_key(words, t, spec)
        listed = F.filter(f"__keys{t}", lambda k: F.bit_count(k.bitwiseXOR(own)) <= spec.probe_bits)
        return F.transform(listed, lambda k: F.struct(F.lit(t).alias("table_idx"), k.alias("hash_key")))

    near = (
        attach_run(queries, first_keys, kinds)
        .select(*queries.columns, F.explode(F.concat(*[close(t) for t in range(spec.probe_tables)])).alias("__near"))
        .select(*queries.columns, "__near.table_idx", "__near.hash_key")
    )
    bits = F.lit(0)
    mine = F.lit(False)
    for t in range(spec.probe_tables):
        listed = F.array_contains(F.col(f"__keys{t}"), table_key(words, t, spec))
        bits = bits + F.when(listed, 1 << t).otherwise(0)
        mine = mine | ((F.col("table_idx") == t) & listed)
    probed = (
        attach_run(model.index.where(F.col("table_idx") < spec.probe_tables), first_keys, kinds)
        .where(mine)
        .withColumn("probe_bits", bits)
        .drop(*kinds)
    )
    met = _meet(model, near, probed, model.index_rows, few)
    q, c = _pair_keys(spec)
    first = F.lit(True)
    for t in range(spec.probe_tables - 1):
        again = (F.col("probe_bits").bitwiseAND(F.lit(1 << t)) != 0) & (
            F.bit_count(table_key(q, t, spec).bitwiseXOR(table_key(c, t, spec))) <= spec.probe_bits
        )
        first = first & ((F.col("table_idx") <= t) | ~again)
    return met.where(first).select("run", "query", "code")


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """Number of candidates, smallest distance and mean of the k smallest, per query.

    Pairs become counts per distance first, so a query is at most 65 numbers.
    """
    counts = pairs.groupBy("run", "query", hamming(F.col("query"), F.col("code")).alias("d")).agg(F.count("*").alias("n"))
    grouped = counts.groupBy("run", "query").agg(
        F.sum("n").alias("candidates"),
        F.min("d").alias("min_distance"),
        F.sort_array(F.collect_list(F.struct("d", "n"))).alias("hist"),
    )

    def add(acc, x):
        take = F.least(x["n"], F.lit(k) - acc["taken"])
        return F.struct((acc["taken"] + take).alias("taken"), (acc["total"] + take * x["d"]).alias("total"))

    zero = F.struct(F.lit(0).cast("bigint").alias("taken"), F.lit(0).cast("bigint").alias("total"))
    mean = F.aggregate("hist", zero, add, lambda a: a["total"].cast("double") / a["taken"].cast("double"))
    return grouped.select(
        "run", "query", "candidates", "min_distance",
        F.least("candidates", F.lit(k)).alias("k"), mean.alias("avg_distance"),
    )


def _compare_buckets(families: dict[int, np.ndarray], tables: int, functions: int, k: int, tile: int):
    """Bucket-mates of the queries in a partition; refers to nothing that workers lack.

    Rows: bucket (run, table and key in one number), code, and whether it is a query. A bucket is compared as arrays, small ones together.
    A pair is left out if it meets in an earlier table as well. Result, a row per query and table: run, query, candidates
    and the ``k`` smallest distances.
    """
    per_word = 63 // functions

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        SMALL = 512  # pairs of a bucket that is compared together with others

        def table_keys(codes, run, upto):
            """The keys of the first tables, a row per table."""
            words = []
            for lookup in families[run][: -(-upto // per_word)]:
                word = np.zeros(len(codes), np.int64)
                for j in range(8):
                    word ^= lookup[j][(codes >> (8 * j)) & 255]
                words.append(word)
            mask = (1 << functions) - 1
            keys = [(words[t // per_word] >> (functions * (t % per_word)) & mask).astype(np.int32) for t in range(upto)]
            return np.array(keys, np.int32).reshape(upto, len(codes))

        def counted(run, table, queries, codes, starts, lengths, c_starts, c_lengths):
            """How many mates of each query lie at each distance, for the buckets that start there."""
            earlier, known = table_keys(queries, run, table), table_keys(codes, run, table)
            counts = np.zeros((len(queries), 65), np.int32)
            pairs = lengths * c_lengths
            small = np.flatnonzero(pairs <= SMALL)
            step = max(1, (8 * tile) // SMALL)
            for i in range(0, len(small), step):
                some = small[i : i + step]
                n = pairs[some]
                at = np.repeat(np.arange(len(some)), n)
                place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                row, column = starts[some][at] + place // c_lengths[some][at], c_starts[some][at] + place % c_lengths[some][at]
                first = np.ones(len(at), bool)
                for t in range(table):
                    first &= earlier[t, row] != known[t, column]
                row, column = row[first], column[first]
                d = np.bitwise_count((queries[row] ^ codes[column]).view(np.uint64))
                np.add.at(counts.reshape(-1), row * 65 + d, 1)
            for b in np.flatnonzero(pairs > SMALL).tolist():
                start, end, c_start, c_end = starts[b], starts[b] + lengths[b], c_starts[b], c_starts[b] + c_lengths[b]
                wide = min(c_end - c_start, 4096)
                high = max(1, tile // wide)
                for q in range(start, end, high):
                    left = slice(q, min(q + high, end))
                    rows = left.stop - q
                    for c in range(c_start, c_end, wide):
                        right = slice(c, min(c + wide, c_end))
                        d = np.bitwise_count((queries[left, None] ^ codes[None, right]).view(np.uint64))
                        met = np.zeros(d.shape, bool)
                        for t in range(table):
                            met |= earlier[t, left, None] == known[t, None, right]
                        d[met] = 65
                        places = d + 66 * np.arange(rows, dtype=np.int32)[:, None]
                        counts[left] += np.bincount(places.ravel(), minlength=66 * rows).reshape(rows, 66)[:, :65].astype(np.int32)
            return counts

        def rows_of(run, queries, counts):
            total = counts.sum(1, dtype=np.int64)
            some = np.flatnonzero(total)
            taken = np.minimum(np.cumsum(counts[some], 1), k)
            take = np.diff(taken, axis=1, prepend=0)
            near = np.repeat(np.tile(np.arange(65, dtype=np.int8), len(some)), take.ravel())
            ends = np.concatenate([[0], np.cumsum(taken[:, -1] if len(some) else [])]).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), run, np.int32)), pa.array(queries[some]), pa.array(total[some]), pa.ListArray.from_arrays(pa.array(ends), pa.array(near))],
                ["run", "query", "candidates", "near"],
            )

        read = [[b.column(name).to_numpy(zero_copy_only=False) for name in ("bucket", "code", "asked")] for b in batches]
        if not read:
            return
        bucket, code, asked = (np.concatenate(column) for column in zip(*read))
        sides = []
        for side in (asked, ~asked):
            order = np.flatnonzero(side)
            order = order[np.argsort(bucket[order], kind="stable")]
            sides.append((code[order], *np.unique(bucket[order], return_index=True, return_counts=True)))
        (queries, buckets, q_start, q_length), (codes, c_buckets, c_start, c_length) = sides
        shared, mine, theirs = np.intersect1d(buckets, c_buckets, assume_unique=True, return_indices=True)
        section = shared >> 49
        ends = np.flatnonzero(np.diff(section, append=-1)) + 1
        start = 0
        for end in ends.tolist():
            # Sections are cut so that the counts of a piece stay small.
            run, table = divmod(int(section[start]), tables)
            while start < end:
                reach = (q_start + q_length)[mine[start:end]] - q_start[mine[start]]
                stop = start + max(1, int(np.searchsorted(reach, tile, "right")))
                a, b = mine[start:stop], theirs[start:stop]
                q0, q1, c0, c1 = q_start[a[0]], q_start[a[-1]] + q_length[a[-1]], c_start[b[0]], c_start[b[-1]] + c_length[b[-1]]
                found = counted(run, table, queries[q0:q1], codes[c0:c1], q_start[a] - q0, q_length[a], c_start[b] - c0, c_length[b])
                yield rows_of(run, queries[q0:q1], found)
                start = stop

    return compare


def _block_mates(model: LshModel, queries: DataFrame, k: int, one_in: int = 1) -> DataFrame:
    """run, query, candidates and ``near``, the ``k`` smallest distances: bucket-mates compared bucket by bucket in tasks.

    Buckets are dealt to partitions of about ``BLOCK_ROWS`` rows of both sides; hot buckets are split as in a join.
    """
    spec, queries = model.spec, hold(queries)
    known = model.codes if one_in == 1 else model.codes.where(F.pmod(F.xxhash64("embedding"), F.lit(one_in)) == 0)
    on = ["run", "table_idx", "hash_key"]
    left = explode_keys(queries, spec).select(*on, F.col("embedding").alias("query"))
    right = explode_keys(known, spec).select(*on, F.col("embedding").alias("code"))
    left, right, on = _split_hot(model, left.where("hash_key is not null"), right.where("hash_key is not null"))
    bucket = F.shiftleft((F.col("run") * spec.tables + F.col("table_idx")).cast("bigint"), 49).bitwiseOR(F.col("hash_key").cast("bigint"))
    if "part" in on:
        bucket = bucket.bitwiseOR(F.shiftleft((F.col("part") * QUERY_SPREAD + F.col("spread")).cast("bigint"), 32))
    rows = left.select(bucket.alias("bucket"), F.col("query").alias("code"), F.lit(True).alias("asked")).unionByName(
        right.select(bucket.alias("bucket"), "code", F.lit(False).alias("asked"))
    )
    n = queries.count() * spec.tables + model.index_rows // one_in
    parts = max(model.spark.sparkContext.defaultParallelism, -(-n // BLOCK_ROWS))
    dealt = rows.repartitionById(parts, F.pmod(F.xxhash64("bucket"), F.lit(parts)).cast("int"))
    families = {r: np.array([f.byte_tables(w) for w in range(f.word_count)], np.int64) for r, f in model.families.items()}
    compare = _compare_buckets(families, spec.tables, spec.functions, k, TILE_PAIRS)
    found = dealt.mapInArrow(compare, "run int, query bigint, candidates bigint, near array<tinyint>")
    near = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k)
    return found.groupBy("run", "query").agg(F.sum("candidates").alias("candidates"), near.alias("near"))


def nearest_mates(model: LshModel, queries: DataFrame, k: int, few: bool = False, one_in: int = 1) -> DataFrame:
    """``nearest`` of the bucket-mates: a join with a small index or of few queries, else bucket by bucket."""
    if few or -(-model.index_rows // one_in) <= BROADCAST_INDEX_ROWS:
        return nearest(bucket_pairs(model, queries, few, one_in), k)
    total = F.aggregate("near", F.lit(0).cast("bigint"), lambda a, d: a + d)
    return _block_mates(model, queries, k, one_in).select(
        "run", "query", "candidates", F.get("near", F.lit(0)).cast("int").alias("min_distance"),
        F.least("candidates", F.lit(k)).alias("k"), (total.cast("double") / F.size("near").cast("double")).alias("avg_distance"),
    )


def mate_distances(model: LshModel, queries: DataFrame, k: int) -> DataFrame:
    """``(query, d, n)``: how many bucket-mates lie at each distance, up to the k-th nearest of them at least."""
    if model.index_rows <= BROADCAST_INDEX_ROWS:
        met = bucket_pairs(model, queries).select("query", hamming(F.col("query"), F.col("code")).alias("d"))
    else:
        met = _block_mates(model, queries, k).select("query", F.explode(F.col("near").cast("array<int>")).alias("d"))
    return met.groupBy("query", "d").agg(F.count("*").alias("n"))


def knn(model: LshModel, codes: DataFrame, settled: Column | None = None) -> DataFrame:
    """Nearest-neighbour summary of each distinct ``(run, embedding)`` in ``codes``.

    Result: run, embedding, candidates (0 if none), min_distance, k,
    avg_distance, probed.

    ``settled`` is a condition on a summary and the run's statistics. Queries that meet it on a share of
    the index codes leave with that summary; the others go on to a larger share, and in the end to all
    codes. So a query in a crowded bucket does not meet every code of it.
    """
    spec = model.spec
    # Both are read more than once: the queries by join, probe and result, the
    # neighbours by the result and by the search for queries without any.
    queries = hold(model.hash(codes.select("run", "embedding").distinct()))
    left, early, count = queries, [], queries.count()
    limit = BROADCAST_INDEX_ROWS // spec.tables
    share, size = max(limit, 1), model.index_rows // spec.tables
    while settled is not None and count > limit and ROUND_STEP * share <= size:
        part = nearest_mates(model, left, spec.neighbours, one_in=-(-size // share))
        early.append(hold(model.with_stats(part).where(settled).select(*part.columns).withColumn("probed", F.lit(False))))
        left = hold(left.join(early[-1].select("run", F.col("query").alias("embedding")), ["run", "embedding"], "left_anti"))
        share, count = share * ROUND_STEP, left.count()
    few = count <= limit
    exact = hold(nearest_mates(model, left, spec.neighbours, few).withColumn("probed", F.lit(False)))
    found = exact
    if spec.probe_tables and model.probes:
        missed = left.join(exact.select("run", F.col("query").alias("embedding")), ["run", "embedding"], "left_anti")
        extra = nearest(probe_pairs(model, missed, few), spec.neighbours).withColumn("probed", F.lit(True))
        found = exact.unionByName(extra)
    for part in early:
        found = found.unionByName(part)
    found = found.withColumnRenamed("query", "embedding")
    return queries.select("run", "embedding").join(found, ["run", "embedding"], "left").select(
        "run", "embedding",
        F.coalesce("candidates", F.lit(0)).cast("bigint").alias("candidates"),
        F.col("min_distance").cast("int").alias("min_distance"),
        F.coalesce("k", F.lit(0)).cast("bigint").alias("k"),
        "avg_distance",
        F.coalesce("probed", F.lit(False)).alias("probed"),
    )


def index_stats(index: DataFrame, spec: LshSpec) -> DataFrame:
    """Per table: buckets, codes, flows, largest and mean bucket, skew, logical bytes."""
    buckets = index.groupBy("table_idx", "hash_key").agg(
        F.count("*").alias("codes"), F.sum("n_flows").alias("flows")
    )
    return buckets.groupBy("table_idx").agg(
        F.count("*").alias("buckets"),
        F.sum("codes").alias("codes"),
        F.sum("flows").alias("flows"),
        F.max("codes").alias("max_bucket"),
        (F.sum("codes") / F.count("*")).alias("mean_bucket"),
        (F.max("codes") * F.count("*") / F.sum("codes")).alias("skew"),
        # a code of 8 bytes per entry, a key of 4 bytes per bucket
        (F.sum("codes") * 8 + F.count("*") * 4).alias("logical_bytes"),
    )
