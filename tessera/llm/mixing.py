"""Mixing sources to target weights by systematic sampling.

Sources take targets by weight, capped at `most` times their size; the excess goes
to the others by weight. With the sources in order of cap per weight the level at
which all is shared has a closed form, so no loop is needed. Every document of a
source expects target/size copies. Expected copies are summed over the source's
documents in a fixed order, one random offset is added, and a document is emitted
once for each integer that its part of the sum crosses.

The order runs through every second size class upwards, by rising size, and back down
through the others, by falling size: neighbours are alike, and both ends are small, so the
words taken stay near the target. Rows of equal size follow the MD5 of their id, which is
the whole order: it does not depend on how the rows are split. The running sum is made in
steps, over the counts of size classes, of sizes in a class and of buckets (the first hex
digits of the MD5) of a size, and then within a bucket; so a source, or one size, that
holds a third of all rows is spread over many tasks.

Edge cases: a null text has size 0 and is never taken in words; a null source is a
source of its own, last in order; repeated rows and null ids are rows like any
other (equal rows may get different copies); an empty table gives no rows. Columns
other than doc_id, text and source are not looked at; `mark` and `emit` hand them on,
and a column `copies` of the documents' own is replaced.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Hex digits of the id's MD5 by which rows of one source and size are dealt.
DIGITS = 3


def sizes(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source and size (words of the text), and what else is asked for."""
    return docs.select("doc_id", F.col("source").isNull().alias("nowhere"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *more)


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(nowhere, source, source_size, target): one row a source."""
    whole = Window.partitionBy()  # over sources, not rows
    by_name = whole.orderBy("nowhere", "source")
    by_cap = whole.orderBy("ratio", "nowhere", "source")
    sums = sized.groupBy("nowhere", "source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array([F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sums.select("*", weight.alias("weight"), F.sum("source_size").over(whole).alias("total"), (F.col("source_size") * F.lit(most)).alias("cap"))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", (F.col("total") - before) / rest)
    # levels rise while sources are capped and fall after: the first that holds is the one
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "nowhere", "source", "level"))).over(whole)["level"]
    return t.select("nowhere", "source", "source_size", F.least("cap", F.col("weight") * F.coalesce(level, F.lit(0.0))).alias("target"))


def place(sized: DataFrame, weights: tuple[int, ...], most: float, seed: int) -> DataFrame:
    """Adds source_size, target and copies to each row of written `sizes`."""
    offset = random.Random(seed).random()
    step = F.floor(F.log2(F.col("size") + F.lit(1.0)) * 4).cast("int")
    up = F.col("step") % 2 == 0
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = sized.withColumn("step", step).withColumns({
        "step": F.when(up, F.col("step")).otherwise(1000 - F.col("step")), "by_size": F.when(up, F.col("size")).otherwise(-F.col("size")),
        "bucket": F.substring(hashed, 1, DIGITS), "rest": F.substring(hashed, DIGITS + 1, 32),
    })
    levels = ["nowhere", "source", "step", "by_size", "bucket"]
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    counts = sized.groupBy(*levels).agg(F.count("*").alias("n"))
    # the rows before a bucket: those of earlier classes, of earlier sizes in its class, of earlier buckets in its size
    ahead = targets(sized, weights, most)
    for depth in range(3, 6):
        by, key = levels[: depth - 1], levels[depth - 1]
        part = counts.groupBy(*levels[:depth]).agg(F.sum("n").alias("n")) if depth < 5 else counts
        part = part.select(*levels[:depth], F.coalesce(F.sum("n").over(earlier(*by).orderBy(key)), F.lit(0)).alias("own"))
        held = [c for c in ahead.columns if c not in by and c != "ahead"]
        ahead = part.join(ahead, by).select(*levels[:depth], *held, (F.col("own") + (F.col("ahead") if "ahead" in ahead.columns else F.lit(0))).alias("ahead"))
    placed = sized.join(ahead, levels).withColumn("at", F.col("ahead") + F.row_number().over(Window.partitionBy(*levels).orderBy("rest", "doc_id")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    placed = placed.withColumn("rate", rate)
    copies = F.floor(F.col("rate") * F.col("at") + F.lit(offset)) - F.floor(F.col("rate") * (F.col("at") - 1) + F.lit(offset))
    return placed.withColumn("copies", copies.cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of each document."""
    sized = materialize(sizes(docs), "sizes")  # three passes need it; the texts are read once
    return place(sized, weights, most, seed).select(
        "doc_id", F.when(~F.col("nowhere"), F.col("source")).alias("source"), "size", "source_size", F.round("target", 6).alias("target"), "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mark(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 11) -> DataFrame:
    """The documents with all their columns, and the copies of each, as `mix` has them.
    Ids may be null or repeated, so rows are numbered in a written table and joined by that."""
    document = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "copies")).alias("document")
    held = materialize(sizes(docs, F.monotonically_increasing_id().alias("row"), document), "numbered")
    copies = place(held.drop("document"), weights, most, seed).select("row", "copies")
    return held.select("row", "document").join(copies, "row").select("document.*", "copies")


def emit(marked: DataFrame) -> DataFrame:
    """The mix itself: each document of `mark` once for each of its copies."""
    return marked.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("copies")


#: The same in SQL, at the default weights and seed.
SQL = f"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS nowhere, coalesce(source, '') AS source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
sums AS (SELECT nowhere, source, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY nowhere, source) - 1) % 3 + 1)::DOUBLE AS weight,
            sum(source_size) OVER ()::DOUBLE AS total, source_size * 3::DOUBLE AS cap FROM sums),
levels AS (SELECT *, cap / weight AS ratio, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, nowhere, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY cap / weight, nowhere, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
chosen AS (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, nowhere, source LIMIT 1),
aims AS (SELECT nowhere, source, source_size, least(cap, weight * coalesce((SELECT level FROM chosen), 0)) AS target FROM levels),
stepped AS (SELECT *, floor(log2(size + 1::DOUBLE) * 4)::INT AS raw FROM sized),
placed AS (SELECT *, row_number() OVER (PARTITION BY nowhere, source ORDER BY CASE WHEN raw % 2 = 0 THEN raw ELSE 1000 - raw END, CASE WHEN raw % 2 = 0 THEN size ELSE -size END, md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST) AS pos FROM stepped),
rated AS (SELECT p.*, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS rate
          FROM placed p JOIN aims a USING (nowhere, source)),
copied AS (SELECT *, (floor(rate * pos + {random.Random(11).random()!r}::DOUBLE) - floor(rate * (pos - 1) + {random.Random(11).random()!r}::DOUBLE))::BIGINT AS copies FROM rated)
SELECT doc_id, CASE WHEN NOT nowhere THEN source END AS source, size, source_size, round(target, 6) AS target, copies, size * copies AS taken FROM copied
"""
