"""Chat formatting with cumulative-snapshot collapse.

A logging client writes a conversation again each time it grows. Each turn gets
two 64-bit hashes of its number, role and text; a prefix's hash is their running
sum in 32-bit halves. A turn is all rows under its number, in any order: a prefix ends
between two turn numbers, never within one, and rows that are repeated under a turn make
it another turn. A conversation whose whole hash is among the proper prefixes of
others is a snapshot and goes (anti-join); of equal conversations the smallest
conv_id stays. What is left is rendered.

The running sum goes by blocks of `BLOCK` turns and then over the blocks, so a
conversation of any length is spread; prefixes are made distinct before the
anti-join, so a first turn that many share is one row.

Edge cases: rows without conv_id belong to no conversation and are left out; a
null turn sorts before the others; a null role renders as `unknown`, a null text
as empty (but differs from an empty one); an empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast

#: Turns whose running sum is made in one step.
BLOCK = 1024
#: Where a null turn is.
BEFORE = -(1 << 62)
SUMS = ["s1", "s2", "s3", "s4"]


def turn_sums(turns: DataFrame) -> DataFrame:
    """(conv_id, at, s1..s4, n): the hash sums of each turn number."""
    fields = (F.col("turn").isNull(), "turn", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    low = F.lit(0xFFFFFFFF).cast("long")
    df = turns.where(F.col("conv_id").isNotNull()).select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(BEFORE)).alias("at"), F.xxhash64(F.lit(1), *fields).alias("h"), F.xxhash64(F.lit(2), *fields).alias("g"))
    parts = [F.shiftrightunsigned("h", 32), F.col("h").bitwiseAND(low), F.shiftrightunsigned("g", 32), F.col("g").bitwiseAND(low)]
    return df.groupBy("conv_id", "at").agg(*(F.sum(p).alias(s) for p, s in zip(parts, SUMS, strict=True)), F.count("*").alias("n"))


def prefixes(sums: DataFrame) -> DataFrame:
    """(conv_id, at, s1..s4, n) summed over the turns up to `at`."""
    df = sums.withColumn("block", F.floor(F.col("at") / BLOCK))
    inner = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cols = [*SUMS, "n"]
    ahead = df.groupBy("conv_id", "block").agg(*(F.sum(c).alias(c) for c in cols)).select("conv_id", "block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b_{c}") for c in cols))
    df = df.select("conv_id", "block", "at", *(F.sum(c).over(inner).alias(c) for c in cols))
    return df.join(ahead, ["conv_id", "block"]).select("conv_id", "at", *((F.col(c) + F.col(f"b_{c}")).alias(c) for c in cols))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_rows, n_copies): conversations that are no prefix of a longer
    one, the smallest id of equal ones."""
    sums = materialize(turn_sums(turns), "turns")  # three passes need it
    key = ["at", *SUMS]
    whole = sums.groupBy("conv_id").agg(F.max("at").alias("at"), *(F.sum(c).alias(c) for c in [*SUMS, "n"]))
    classes = whole.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.max("n").alias("n_rows"), F.count("*").alias("n_copies"))
    ends = whole.select("conv_id", F.col("at").alias("last"))
    shorter = prefixes(sums).join(ends, "conv_id").where(F.col("at") < F.col("last")).select(*key).distinct()
    return classes.join(shorter, key, "left_anti").select("conv_id", "n_rows", "n_copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered): each kept conversation in turn markup."""
    mark = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    kept = materialize(kept, "maximal")
    # dropped conversations' texts go no further than the scan, if the kept ids can be sent out
    rows = turns.select("conv_id", F.struct("turn", "role", "text", mark.alias("mark")).alias("row")).join(maybe_broadcast(kept, kept.count()), "conv_id")
    ordered = F.transform(F.array_sort(F.collect_list("row")), lambda r: r["mark"])
    return rows.groupBy("conv_id").agg(F.max("n_rows").alias("n_turns"), F.max("n_copies").alias("n_copies"), F.array_join(ordered, "").alias("rendered"))


def collapse(turns: DataFrame) -> DataFrame:
    return render(turns, maximal(turns))


SQL = """
WITH t AS (SELECT conv_id, turn, list({'role': role, 'text': text} ORDER BY role NULLS FIRST, text NULLS FIRST) AS rows, count(*) AS n,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY role NULLS FIRST, text NULLS FIRST) AS marks
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id, turn),
c AS (SELECT conv_id, list({'turn': turn, 'rows': rows} ORDER BY turn NULLS FIRST) AS ts, sum(n)::BIGINT AS n, string_agg(marks, '' ORDER BY turn NULLS FIRST) AS rendered FROM t GROUP BY conv_id),
k AS (SELECT ts, n, rendered, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY ALL)
SELECT conv_id, n AS n_turns, n_copies, rendered FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE len(c.ts) > len(k.ts) AND c.ts[1:len(k.ts)] = k.ts)
"""
