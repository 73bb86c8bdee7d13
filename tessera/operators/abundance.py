"""Relative abundance of clusters and taxa."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import clip, counted
from .taxonomy import roll_up

EPS = 10 * 2.0**-23
#: Clipping bounds before the logarithm.
FLOOR, CEILING = 1e-5, 1.0


def relative_depth(cells: DataFrame, min_depth: float = 0.1) -> DataFrame:
    """(sample, cluster, value) of cells (sample, cluster, bases, length, mapped), and
    rows whose cluster is null for reads that are on none.

    Depth is bases over length; a cluster under `min_depth` has depth 0 and its reads
    are unmapped. A value is the cluster's share of all depth times the share of reads
    that are mapped."""
    depth = F.coalesce(F.col("bases") / (F.col("length") + EPS), F.lit(0.0))
    df = cells.withColumn("depth", F.when(F.col("cluster").isNotNull() & (depth >= min_depth), depth).otherwise(0.0))
    kept = (F.col("depth") > 0) | ((depth >= min_depth) & F.col("cluster").isNotNull())
    totals = df.groupBy("sample").agg(F.sum("depth").alias("all_depth"), F.sum(F.when(kept, F.col("mapped")).otherwise(0)).alias("on"), F.sum("mapped").alias("reads"))
    value = F.col("depth") * F.col("on") / ((F.col("reads") + EPS) * (F.col("all_depth") + EPS))
    return df.where("cluster is not null").join(totals, "sample").select("sample", "cluster", value.alias("value"))


def cluster_cells(reads: DataFrame, sequences: DataFrame, annotation: DataFrame, min_mapq: int = 0, identity: float = 0.9, trim: int = 0) -> DataFrame:
    """(sample, cluster, bases, length, mapped) from reads (sample, name, length, pos,
    mapq, flag, cigar, nm); a sequence's cluster is its name up to the first dot. Reads
    that are unmapped, or on no annotated cluster, are counted under a null cluster."""
    known = annotation.select(F.col("cluster_id").alias("cluster")).distinct()
    size = F.greatest(F.lit(0), F.col("length") - 2 * trim)
    lengths = sequences.select(F.split("name", r"\.")[0].alias("cluster"), size.alias("n")).groupBy("cluster").agg(F.sum("n").alias("length")).join(known, "cluster", "left_semi")
    inside = lambda b: clip(b["start"], b["end"], F.lit(trim).cast("long"), F.col("length") - trim)
    bases = F.when(F.col("length") > 2 * trim, F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + inside(b))).otherwise(F.lit(0))
    rows = counted(reads, min_mapq, identity).select("sample", F.when(F.col("mapped") == 1, F.split("name", r"\.")[0]).alias("cluster"), bases.alias("bases"))
    sums = rows.groupBy("sample", "cluster").agg(F.sum("bases").alias("bases"), F.count("*").alias("mapped"))
    joined = sums.join(lengths, "cluster", "left")
    return joined.select("sample", F.when(F.col("length").isNotNull(), F.col("cluster")).alias("cluster"), "bases", F.coalesce("length", F.lit(0)).alias("length"), "mapped")


def abundance(reads: DataFrame, sequences: DataFrame, annotation: DataFrame, min_mapq: int = 0, identity: float = 0.9, trim: int = 0, min_depth: float = 0.1) -> DataFrame:
    """(sample, node, value) for every taxon."""
    values = relative_depth(cluster_cells(reads, sequences, annotation, min_mapq, identity, trim), min_depth)
    placed = values.join(annotation.select(F.col("cluster_id").alias("cluster"), "classification"), "cluster")
    return roll_up(placed, "classification", "value", ["sample"])


def log_abundance(values: DataFrame, value: str = "value") -> DataFrame:
    """Values brought into [FLOOR, CEILING], then their decimal logarithm."""
    return values.withColumn(value, F.log10(F.least(F.lit(CEILING), F.greatest(F.lit(FLOOR), F.col(value)))))
