"""How well bins recover genomes: contingency, best match, threshold grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def strict_join(left: DataFrame, right: DataFrame, on: str, what: str = "unknown id") -> DataFrame:
    """Inner join that fails if a row of `left` has no partner."""
    joined = left.join(right.withColumn("_there", F.lit(True)), on, "left")
    ok = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit(f"{what}: "), F.col(on).cast("string")))).otherwise(F.lit(True))
    return joined.where(ok).drop("_there")


def contingency(mapping: DataFrame, truth: DataFrame) -> DataFrame:
    """(cluster_id, genome_id, bp): bases that a cluster shares with a genome."""
    return strict_join(mapping, truth, "seq_id").groupBy("cluster_id", "genome_id").agg(F.sum("length").alias("bp"))


def genome_lengths(truth: DataFrame) -> DataFrame:
    return truth.groupBy("genome_id").agg(F.sum("length").alias("genome_bp"))


def best_match(cells: DataFrame, genomes: DataFrame) -> DataFrame:
    """(cluster_id, genome_id, recall, precision): the genome that a cluster holds the
    largest part of; the first by id on ties."""
    both = cells.join(genomes, "genome_id").withColumn("recall", F.col("bp") / F.col("genome_bp"))
    # the least struct is a partial aggregate: no cluster is sorted or joined again
    top = both.groupBy("cluster_id").agg(F.min(F.struct((-F.col("recall")).alias("r"), "genome_id", "bp")).alias("b"), F.sum("bp").alias("cluster_bp"))
    return top.select("cluster_id", "b.genome_id", (-F.col("b.r")).alias("recall"), (F.col("b.bp") / F.col("cluster_bp")).alias("precision"))


def threshold_grid(scores: DataFrame, spark: SparkSession, recall: list[float], precision: list[float]) -> DataFrame:
    """(precision_t, recall_t, clusters): clusters at or above both thresholds. One pass:
    each cell is a conditional count."""
    cells = [(p, r) for p in sorted(precision) for r in sorted(recall, reverse=True)]
    counts = scores.agg(*(F.count_if((F.col("recall") >= r) & (F.col("precision") >= p)).alias(f"c{i}") for i, (p, r) in enumerate(cells)))
    rows = F.array(*(F.struct(F.lit(float(p)).alias("precision_t"), F.lit(float(r)).alias("recall_t"), F.col(f"c{i}").alias("clusters")) for i, (p, r) in enumerate(cells)))
    return counts.select(F.inline(rows))


def quality_grid(scores: DataFrame, contamination: list[float], completeness: list[float]) -> DataFrame:
    """(dataset, program, contamination_t, completeness_t, clusters) of scores (dataset,
    program, completeness, contamination); a program without clusters in a dataset has
    zeros there."""
    cells = [(c, q) for c in sorted(contamination) for q in sorted(completeness, reverse=True)]
    counts = scores.groupBy("dataset", "program").agg(*(F.count_if((F.col("contamination") <= c) & (F.col("completeness") >= q)).alias(f"c{i}") for i, (c, q) in enumerate(cells)))
    every = scores.select("dataset").distinct().crossJoin(F.broadcast(scores.select("program").distinct()))
    counts = every.join(counts, ["dataset", "program"], "left")
    rows = F.array(*(F.struct(F.lit(float(c)).alias("contamination_t"), F.lit(float(q)).alias("completeness_t"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("clusters")) for i, (c, q) in enumerate(cells)))
    return counts.select("dataset", "program", F.inline(rows))


def stacked(grid: DataFrame, by: list[str], order: str, count: str = "clusters") -> DataFrame:
    """Adds left and width: the parts of a stacked bar, by falling threshold."""
    before = F.lag(count, 1, 0).over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return grid.select("*", before.alias("left"), (F.col(count) - before).alias("width"))


def labelled(df: DataFrame, spark: SparkSession, labels: dict[str, str], column: str = "program") -> DataFrame:
    """Adds `label`: the program's label, itself where there is none."""
    names = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)) if labels else F.lit(None).cast("map<string,string>")
    return df.withColumn("label", F.coalesce(F.try_element_at(names, F.col(column)), F.col(column)))
