"""Pileup, allele frequencies and site filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binning import strict_join
from .intervals import accepted

EPS = 10 * 2.0**-23
ALLELES = "ACGT"


def bases(reads: DataFrame, min_mapq: int = 0, identity: float = 0.9) -> DataFrame:
    """(sample, name, pos, base): each aligned base of accepted reads, 0-based; letters
    other than ACGT are dropped."""
    hits = accepted(reads, min_mapq, identity).select("sample", "name", "seq", F.inline("blocks"))
    part = hits.select("sample", "name", "start", F.expr("substring(seq, cast(read + 1 as int), cast(end - start as int))").alias("part"))
    letters = part.select("sample", "name", "start", F.posexplode(F.split("part", "")).alias("i", "base"))
    return letters.where(F.col("base").isin(*ALLELES)).select("sample", "name", (F.col("start") + F.col("i")).alias("pos"), "base")


def pileup(rows: DataFrame, site: list[str], base: str = "base", sample: str = "sample") -> DataFrame:
    """(site, sample, acgt): counts of A, C, G and T."""
    counts = [F.count_if(F.col(base) == a).cast("double") for a in ALLELES]
    return rows.groupBy(*site, sample).agg(F.array(*counts).alias("acgt"))


def major(acgt: Column) -> Column:
    """The index (0-based) of the greatest; the first of equals."""
    return (F.array_position(acgt, F.array_max(acgt)) - 1).cast("int")


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def sites(counts: DataFrame, site: list[str], samples: int, depth: float = 1, coverage: float = 0.5, dominant: float = 0.05, mono: float = 0.99) -> DataFrame:
    """(site, population, calls): allele frequencies to 4 places of the sites that pass.

    Counts under `depth` become 0, base by base, in samples and in the population
    alike. A site stays if at least `coverage` of all samples have a base left, and not
    more than `mono` of these have the population's major allele above `dominant`.
    calls: map of sample to frequencies; a sample without bases is absent."""
    floor = lambda a: F.transform(a, lambda c: F.when(c < depth, 0.0).otherwise(c))
    summed = [F.sum(F.get("acgt", F.lit(i))) for i in range(4)]
    kept = counts.withColumn("left", floor(F.col("acgt")))
    # the rows of a site meet once: samples are bounded by the study, not by the data
    by = kept.groupBy(*site).agg(F.array(*summed).alias("population"), F.collect_list(F.struct("sample", "left")).alias("samples"))
    by = by.withColumn("population", floor(F.col("population"))).withColumn("samples", F.filter("samples", lambda s: _total(s["left"]) > 0)).withColumn("m", major(F.col("population")))
    frequencies = lambda a: F.transform(a, lambda c: c / (_total(a) + EPS))
    by = by.withColumn("calls", F.transform("samples", lambda s: F.struct(s["sample"].alias("sample"), frequencies(s["left"]).alias("f"))))
    n = F.size("calls")
    high = F.size(F.filter("calls", lambda s: F.get(s["f"], F.col("m")) > dominant))
    by = by.where((n / samples >= coverage) & (high / (n + EPS) <= mono))
    rounded = lambda a: F.transform(a, lambda c: F.bround(c, 4))
    return by.select(*site, rounded(frequencies(F.col("population"))).alias("population"), F.map_from_entries(F.transform("calls", lambda s: F.struct(s["sample"], rounded(s["f"])))).alias("calls"))


def variants(reads: DataFrame, annotation: DataFrame, samples: int, min_mapq: int = 0, identity: float = 0.9, depth: float = 1, coverage: float = 0.5) -> DataFrame:
    """(classification, chrom, pos, population, calls), pos from 1."""
    found = sites(pileup(bases(reads, min_mapq, identity), ["name", "pos"]), ["name", "pos"], samples, depth, coverage)
    # a reference whose cluster the annotation lacks fails
    named = strict_join(found.withColumn("cluster_id", F.split("name", r"\.")[0]), annotation, "cluster_id", "no annotation")
    return named.select("classification", F.col("name").alias("chrom"), (F.col("pos") + 1).alias("pos"), "population", "calls")


def shown(acgt: Column) -> Column:
    """`a/c/g/t`, or NA."""
    return F.coalesce(F.array_join(F.transform(acgt, lambda c: F.regexp_replace(F.format_string("%.4f", c), r"\.?0+$", "")), "/"), F.lit("NA"))
