"""Mixing sources to target weights by Sainte-Laguë apportionment of equal word blocks.

1. Targets: every source gets its weight's share of the wanted words, at most
   ``cap`` times its own words; what lies above is shared again by weight.
2. Blocks of about ``block_words`` words are allotted to the sources by highest
   quotients ``weight / (2 * seats + 1)``.
3. A source is dealt into shards by a seeded hash of its documents. Its blocks are
   allotted to its shards in the same way, by the words of each shard.
4. In a shard the documents lie in seeded order, cut into equal blocks. With ``n``
   blocks and a quota of ``c * n + r`` every block is taken ``c`` times and a
   cyclic run of ``r`` blocks from a seeded start once more. So most documents
   are taken whole, and only the ends of the run cut one.

Only the list of sources (one row each) is held by the driver: it is the
specification of the mix. Shards hold about ``shard_docs`` documents: they are drawn by id, size
and ``print_of`` (a hash of the text, where there is one), so rows that repeat an id, or have none, are spread too.

Defined results: a null source is a source of its own, after all others; a null
text has no words and nothing is taken; rows with equal or null ids are rows of
their own (equal rows are interchangeable); an empty table gives an empty result.
Other columns of the input are kept inside the struct ``doc``, so names can't clash.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycle_weights(sources: Sequence[str | None]) -> list[float]:
    """5, 2, 1, repeating, for sources in code point order."""
    return [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sources))]


def fill_targets(sizes: Sequence[int], weights: Sequence[float], wanted: float, cap: float) -> list[float]:
    """Share ``wanted`` by weight with every target at most ``cap`` times its size."""
    targets = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if weights[i] > 0]
    left = wanted
    while open_:
        total = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not above:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in above:
            targets[i] = cap * sizes[i]
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(above)]
    return targets


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by highest quotients weight / (2k + 1), none above its cap, ties to the first.

    A divisor found by bisection gives nearly all seats at once; the last ones are
    allotted one by one, so the cost doesn't depend on the number of seats.
    """
    n = len(weights)
    seats = min(seats, sum(c for c, w in zip(caps, weights, strict=True) if w > 0))

    def at(divisor: float) -> list[int]:
        return [min(c, math.floor(w / divisor + 0.5)) if w > 0 else 0 for c, w in zip(caps, weights, strict=True)]

    low, high = 1e-12, 4.0 * max([*weights, 1.0])
    for _ in range(200):
        mid = math.sqrt(low * high)
        if sum(at(mid)) > seats:
            low = mid
        else:
            high = mid
    given = at(high) if n else []
    queue = [(-weights[i] / (2 * given[i] + 1), i) for i in range(n) if weights[i] > 0 and given[i] < caps[i]]
    heapq.heapify(queue)
    for _ in range(seats - sum(given)):
        _, i = heapq.heappop(queue)
        given[i] += 1
        if given[i] < caps[i]:
            heapq.heappush(queue, (-weights[i] / (2 * given[i] + 1), i))
    return given


def _shard_quotas(shards: DataFrame) -> DataFrame:
    """Each source's blocks allotted to its shards by highest quotients.

    A divisor below and one above the right one bracket every shard's seats; the
    few seats between are ranked by quotient. Rows: about two a shard.
    """
    half = F.col("n_shards") / 2.0
    seats = lambda q: F.floor(F.col("w") * F.greatest(q, F.lit(0.0)) / F.col("words") + 0.5)
    bracket = shards.withColumns({
        "base": seats(F.col("quota") - half).cast("long"), "top": seats(F.col("quota") + half).cast("long"),
    })
    own = Window.partitionBy("sid")
    spare = (
        bracket.withColumn("left", F.col("quota") - F.sum("base").over(own))
        .withColumn("k", F.explode(F.sequence("base", F.greatest("base", F.col("top") - 1))))
        .withColumn("rank", F.row_number().over(own.orderBy(F.desc(F.col("w") / (2 * F.col("k") + 1)), "shard", "k")))
        .groupBy("sid", "shard", "w", "blocks", "base", "full", "cap_blocks")
        .agg(F.sum((F.col("rank") <= F.col("left")).cast("long")).alias("more"))
    )
    quota = F.when(F.col("full"), F.col("cap_blocks")).otherwise(F.least(F.col("base") + F.col("more"), "cap_blocks"))
    return spare.select("sid", "shard", "w", "blocks", quota.alias("quota"))


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    size: Column | None = None,
    weights: Callable[[Sequence[str | None]], Sequence[float]] = cycle_weights,
    share: float = 1.5,
    cap: int = 2,
    block_words: int = 32,
    seed: int = 17,
    shard_docs: int = 4096,
    print_of: Column | None = None,
) -> DataFrame:
    """One row per document: doc (its columns), size, source_size, target, taken, spans.

    spans: array of (first word, word after the last, times) that the mix takes.
    """
    spark = docs.sparkSession
    size = word_count(F.col("text")) if size is None else size
    if print_of is None:
        print_of = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col(doc_id).alias("id"), F.col(source).alias("source"), size.alias("size"), print_of.alias("print"),
    )
    stats = rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("words")).collect()
    stats.sort(key=lambda r: (r["source"] is None, r["source"]))
    w = [float(x) for x in weights([r["source"] for r in stats])]
    words = [r["words"] for r in stats]
    target = fill_targets(words, w, share * sum(words), cap)
    # Smaller blocks where a source has less than 16 of them.
    block_words = max(1, min([block_words, *(x // 16 for x in words if x)]))
    blocks = [max(1, round(x / block_words)) if x else 0 for x in words]
    quota = sainte_lague(w, sum(round(t / block_words) for t in target), [cap * b for b in blocks])
    sources = spark.createDataFrame(
        [
            (i, r["source"], r["words"], float(t), q, -(-r["docs"] // shard_docs), bool(t >= cap * x))
            for i, (r, x, t, q) in enumerate(zip(stats, words, target, quota, strict=True))
        ],
        "sid int, source string, words long, target double, quota long, shards int, full boolean",
    )
    dealt = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).select(
        "doc", "id", "size", "sid", "words", "target",
        F.xxhash64(F.lit(seed), "sid", "id", "size", "print").alias("key"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "id", "size", "print"), "shards").cast("int").alias("shard"),
    )
    sizes = dealt.where("size > 0").groupBy("sid", "shard").agg(F.sum("size").alias("w"))
    own = Window.partitionBy("sid")
    quotas = _shard_quotas(
        sizes.join(sources, "sid")
        .withColumn("n_shards", F.count("*").over(own))
        .withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("w") / block_words)).cast("long"))
        .withColumn("cap_blocks", F.col("blocks") * cap)
    )
    order = Window.partitionBy("sid", "shard").orderBy("key", "id", "size")
    placed = dealt.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("begin", F.col("end") - F.col("size"))

    whole = F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks")))
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "sid", "shard"), "blocks")
    last = F.col("first") + F.col("quota") - F.col("whole") * F.col("blocks")
    edge = lambda block: F.floor(block * F.col("w") / F.col("blocks")).cast("long")
    overlap = lambda lo, hi: F.struct(
        (F.greatest("begin", lo) - F.col("begin")).alias("first"),
        (F.least("end", hi) - F.col("begin")).alias("last"), F.lit(1).cast("long").alias("times"),
    )
    spans = F.array(
        F.struct(F.lit(0).cast("long").alias("first"), F.col("size").alias("last"), F.col("whole").alias("times")),
        overlap(edge(F.col("first")), edge(F.least("run_end", "blocks"))),
        overlap(F.lit(0).cast("long"), edge(F.greatest(F.col("run_end") - F.col("blocks"), F.lit(0)))),
    )
    mixed = (
        placed.join(quotas, ["sid", "shard"], "left")
        .withColumn("whole", F.coalesce(whole, F.lit(0)).cast("long"))
        .withColumn("first", first).withColumn("run_end", last)
        .withColumn("spans", F.filter(spans, lambda s: (s["times"] > 0) & (s["last"] > s["first"])))
        .withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<first:bigint,last:bigint,times:bigint>>)")))
    )
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["last"] - s["first"]) * s["times"])
    return mixed.select("doc", "size", F.col("words").alias("source_size"), "target", taken.alias("taken"), "spans")


def mixed_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """The mix itself, with the columns of the input: a row for each time that a document
    is taken, its text cut to the words taken. Documents that are not taken have no row.
    """
    mixed = mix_sources(docs, **options)
    parts = mixed.withColumn("span", F.explode("spans")).select("doc", "size", "span").withColumn(
        "i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("span.times")))
    )
    words = F.regexp_extract_all(F.col(f"doc.{text}"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.when((F.col("span.first") == 0) & (F.col("span.last") == F.col("size")), F.col(f"doc.{text}")).otherwise(
        F.array_join(F.slice(words, (F.col("span.first") + 1).cast("int"), (F.col("span.last") - F.col("span.first")).cast("int")), "")
    )
    parts = parts.withColumn("__cut", cut)
    new = {text: F.col("__cut"), n_chars: F.length("__cut").cast("long")}
    return parts.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    from flowsift.llm.scratch import written

    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("print")), "mix-sizes")
    mixed = mix_sources(sized, size=F.col("size"), print_of=F.col("print"))
    return mixed.select("doc.doc_id", "size", "source_size", "target", "taken", F.col("doc.source").alias("source"), "spans")
