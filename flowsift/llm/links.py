"""URL rules, with link-graph propagation of trust and distrust for hosts that no rule names.

Rules are (verdict, host, path): one fits its host and all subdomains of it if the
url's path starts with the rule's path; the longest wins. Pages that no rule fits
are judged by their host: personalised PageRank runs over the host graph (an edge
for every link to another host) from hosts with allowed pages, and over the
reversed graph from hosts with blocked pages, until no host's rank still changes. A
host is blocked if its distrust is above ``ratio`` times its trust.

Native DataFrame operations only. Edges and seeds are summed before they are
shuffled, so a host that holds a third of the pages is one row per neighbour.

Defined results: a null url or one without ``://`` has an empty host and path, fits
no rule and belongs to the host ``""``; a null html has no links; repeated pages
count as often as they occur; hosts without any link or seed are allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.llm.scratch import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""
#: Verdict, host, path.
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _round(rank: DataFrame, edges: DataFrame, seeds: DataFrame, damping: float) -> DataFrame:
    passed = rank.join(edges, rank["host"] == edges["src"]).select(
        F.col("dst").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank")
    )
    return (
        passed.unionByName(seeds.select("host", ((1 - damping) * F.col("seed")).alias("rank")))
        .groupBy("host").agg(F.sum("rank").alias("rank"))
    )


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int, damping: float, rank: DataFrame | None = None) -> DataFrame:
    """Personalised PageRank. edges: src, dst, share (of src's links); seeds: host, seed (sum 1); rank: where to go on.

    Each round is a join and a sum; every third round is written, so that plans
    stay short and a lost executor costs three rounds at most.
    """
    rank = seeds.withColumnRenamed("seed", "rank") if rank is None else rank
    for i in range(rounds):
        rank = _round(rank, edges, seeds, damping)
        if i % 3 == 2:
            rank = written(rank, "host-rank")
    return rank


def settled(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """Personalised PageRank, iterated until three rounds change no host's rank by more than ``tolerance`` of itself.

    The change is relative to each host, so neither the depth of the graph nor the number of seeds matters: a host
    that was just reached has changed by all of its rank.
    """
    rank = seeds.withColumnRenamed("seed", "rank")
    while True:
        start = rank.withColumnRenamed("rank", "before")
        rank = propagate(edges, seeds, 3, damping, rank)
        change = F.max(F.abs(F.col("rank") - F.coalesce("before", F.lit(0.0))) / F.col("rank"))
        if (rank.where("rank > 0").join(start, "host", "left").agg(change.alias("c")).first()["c"] or 0) <= tolerance:
            return rank


def judge_pages(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, damping: float = 0.85, ratio: float = 2.0, tolerance: float = 1e-6,
) -> DataFrame:
    """page_id, host, path, rule, verdict, and the trust and distrust of the host."""
    host, path = url_parts(F.col("__url"))
    parts = pages.select("page_id", F.col("url").alias("__url"), "html").select("page_id", "html", host.alias("host"), path.alias("path"))
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = parts.withColumn("rule", name).withColumn("said", verdict)
    links = written(
        parts.where(F.col("html").contains("//"))
        .select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
        .select(F.col("host").alias("src"), ascii_lower(F.col("to")).alias("dst"))
        .where("src != dst").groupBy("src", "dst").agg(F.count("*").alias("n")),
        "host-links",
    )
    counts = written(
        judged.groupBy("host").agg(
            F.count_if(F.col("said") == "allow").alias("allowed"), F.count_if(F.col("said") == "block").alias("blocked")
        ),
        "host-seeds",
    )
    totals = counts.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"))

    def ranks(seed: str, src: str, dst: str, out: str) -> DataFrame:
        total = totals.select(F.col("a" if seed == "allowed" else "b").alias("total"))
        seeds = counts.where(F.col(seed) > 0).join(F.broadcast(total)).select("host", (F.col(seed) / F.col("total")).alias("seed"))
        degree = links.groupBy(src).agg(F.sum("n").alias("all"))
        edges = links.join(degree, src).select(
            F.col(src).alias("src"), F.col(dst).alias("dst"), (F.col("n") / F.col("all")).alias("share")
        )
        return settled(written(edges, "host-edges"), written(seeds, "host-seed"), damping, tolerance).withColumnRenamed("rank", out)

    scores = ranks("allowed", "src", "dst", "trust").join(ranks("blocked", "dst", "src", "distrust"), "host", "full")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    own = F.when(distrust > ratio * trust, "block").otherwise("allow")
    return judged.drop("html").join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust")
    )


def op10(spark, sf_dir: str) -> DataFrame:
    judged = judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_sql(rounds: int = 9, damping: float = 0.85, ratio: float = 2.0, least: float = 1e-9) -> str:
    """The same in SQL: rounds unrolled as common table expressions."""
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'"
        for i, (_, h, p) in sorted(enumerate(RULES), key=lambda r: -len(r[1][1]) - len(r[1][2]))
    )
    name = fits.format(*[h + p for _, h, p in RULES])
    said = fits.format(*[v for v, _, _ in RULES])
    link = LINK.replace("'", "''")
    steps = [f"""WITH rest AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END r FROM pages),
    parts AS (SELECT page_id, html, translate(regexp_extract(r, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path FROM rest),
    judged AS (SELECT page_id, host, path, CASE {name} END AS "rule", CASE {said} END said FROM parts),
    found AS (SELECT host src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') dst FROM parts),
    links AS (SELECT src, dst, count(*) n FROM found WHERE src <> dst GROUP BY ALL),
    counts AS (SELECT host, count(*) FILTER (said = 'allow') a, count(*) FILTER (said = 'block') b FROM judged GROUP BY host)"""]
    for tag, seed, src, dst in (("t", "a", "src", "dst"), ("d", "b", "dst", "src")):
        steps.append(f"{tag}e AS (SELECT {src} src, {dst} dst, n / sum(n) OVER (PARTITION BY {src}) AS share FROM links)")
        steps.append(f"{tag}s AS (SELECT host, {seed} / (SELECT sum({seed}) FROM counts) AS seed FROM counts WHERE {seed} > 0)")
        steps.append(f"{tag}0 AS (SELECT host, seed AS r FROM {tag}s)")
        for i in range(rounds):
            steps.append(
                f"{tag}{i + 1} AS (SELECT host, sum(r) AS r FROM (SELECT e.dst AS host, {damping} * r * share AS r FROM {tag}{i} x JOIN {tag}e e ON x.host = e.src "
                f"UNION ALL SELECT host, {1 - damping} * seed FROM {tag}s) GROUP BY host)"
            )
    return ",\n".join(steps) + f"""
    SELECT page_id, j.host, path, "rule", coalesce(said, CASE WHEN coalesce(d.r, 0) > {least} AND coalesce(d.r, 0) > {ratio} * coalesce(t.r, 0) THEN 'block' ELSE 'allow' END) AS verdict
    FROM judged j LEFT JOIN t{rounds} t ON j.host = t.host LEFT JOIN d{rounds} d ON j.host = d.host"""
