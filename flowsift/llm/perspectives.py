"""Multi-party perspective rotation: a dialogue rendered once for each participant.

For every participant the dialogue is rendered with that speaker as the assistant
and all others as named users; the mask marks what the assistant says, its end
mark included. System turns stay system turns; the system is no participant.

A row holds ``turns_per_row`` consecutive turn numbers at most, so a very long dialogue is several
rows (``part`` counts them) and never one group; joined in order of ``part`` they
give the whole rendering.

Native DataFrame operations only. Defined results: exactly repeated turns count
once; turns with the same number are ordered by role, then text, nulls first; a
null or empty role speaks as ``unknown`` and is no participant; a null text is
empty; a null conversation id or turn number is a value of its own (part -1 for
the latter); dialogues without a participant have no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYSTEM = "system"


def rotate_perspectives(turns: DataFrame, turns_per_row: int = 64) -> DataFrame:
    """conv_id, perspective, part, n_turns, text, mask (array of start and length in characters)."""
    rows = turns.select("conv_id", "turn", "role", "text").distinct()
    speaker = F.when(F.coalesce("role", F.lit("")) == "", "unknown").otherwise(F.col("role"))
    rows = rows.select(
        "conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), "role", F.col("text").isNotNull().alias("__has"),
        speaker.alias("name"), F.coalesce(F.floor(F.col("turn") / turns_per_row), F.lit(-1)).cast("long").alias("part"),
    )
    people = rows.where((F.col("name") != SYSTEM) & (F.coalesce("role", F.lit("")) != "")).select("conv_id", F.col("name").alias("perspective")).distinct()
    people = people.withColumnRenamed("conv_id", "__conv")
    head = (
        F.when(F.col("name") == SYSTEM, F.lit("<|system|>\n"))
        .when(F.col("name") == F.col("perspective"), F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user:"), "name", F.lit("|>\n")))
    )
    said = F.concat("text", F.lit("<|end|>"))
    own = (F.col("name") == F.col("perspective")) & (F.col("name") != SYSTEM)
    parts = (
        rows.join(people, rows["conv_id"].eqNullSafe(people["__conv"]))
        .select(
            "conv_id", "perspective", "part",
            F.struct(
                F.col("turn"), F.col("role"), F.col("__has"), F.col("text"), F.concat(head, said, F.lit("\n")).alias("shown"),
                F.length(head).cast("long").alias("before"), F.length(said).cast("long").alias("long"), own.alias("own"),
            ).alias("line"),
        )
        .groupBy("conv_id", "perspective", "part")
        .agg(F.sort_array(F.collect_list("line")).alias("lines"))
    )
    marks = F.expr("""
        aggregate(lines, struct(0L AS at, cast(array() AS array<struct<start:bigint,length:bigint>>) AS mask),
          (a, x) -> struct(a.at + x.before + x.long + 1 AS at,
            IF(x.own, concat(a.mask, array(struct(a.at + x.before AS start, x.long AS length))), a.mask) AS mask)).mask
    """)
    return parts.select(
        "conv_id", "perspective", "part", F.size("lines").cast("long").alias("n_turns"),
        F.array_join(F.transform("lines", lambda x: x["shown"]), "").alias("text"), marks.alias("mask"),
    )


def op8(spark, sf_dir: str) -> DataFrame:
    rotated = rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("+"), m["length"].cast("string"))), ",")
    return rotated.withColumn("mask", spans)


OP8_SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations),
said AS (
  SELECT conv_id, turn, role, text AS raw, coalesce(text, '') AS text,
    CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS name,
    coalesce(CAST(floor(turn / 64) AS BIGINT), -1) AS part FROM turns),
people AS (
  SELECT DISTINCT conv_id, name AS perspective FROM said WHERE name <> 'system' AND coalesce(role, '') <> ''),
lines AS (
  SELECT s.conv_id, p.perspective, part, turn, role, raw, text || '<|end|>' AS said, name = p.perspective AS own,
    CASE WHEN name = 'system' THEN '<|system|>' WHEN name = p.perspective THEN '<|assistant|>'
      ELSE '<|user:' || name || '|>' END || chr(10) AS head
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, length(head) AS before, length(said) AS long,
    row_number() OVER w AS i,
    coalesce(sum(length(head) + length(said) + 1) OVER (PARTITION BY conv_id, perspective, part
      ORDER BY turn NULLS FIRST, role NULLS FIRST, raw NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM lines WINDOW w AS (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role NULLS FIRST, raw NULLS FIRST))
SELECT conv_id, perspective, part, count(*) AS n_turns,
  string_agg(head || said || chr(10), '' ORDER BY i) AS text,
  coalesce(string_agg(CAST(CAST(pos + before AS BIGINT) AS VARCHAR) || '+' || CAST(long AS VARCHAR), ',' ORDER BY i) FILTER (own), '') AS mask
FROM placed GROUP BY conv_id, perspective, part
"""
