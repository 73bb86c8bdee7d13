"""Writers of reports and sequence files; folders of part files, as Spark writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions.sequence import wrapped
from .operators.pileup import shown


def write_tsv(df: DataFrame, path: str, compress: bool = False, order: list[str] | None = None) -> None:
    """Tab-separated with a header; null is NA."""
    df = df.orderBy(*order) if order else df
    df.write.mode("overwrite").options(sep="\t", header=True, nullValue="NA", **({"compression": "gzip"} if compress else {})).csv(path)


def wide(df: DataFrame, keys: list[str], sample: str, value: str, samples: list[str]) -> DataFrame:
    """One column a sample, in the given order."""
    return df.groupBy(*keys).pivot(sample, samples).agg(F.first(value))


def write_coverage(coverage: DataFrame, path: str, samples: list[str]) -> None:
    """Mean and variance of each sample side by side, gzip."""
    w = coverage.groupBy("seq_id").pivot("sample", samples).agg(F.first("mean").alias("Mean"), F.first("variance").alias("Variance"))
    write_tsv(w.withColumnRenamed("seq_id", "Sequence ID"), path, True, ["Sequence ID"])


def write_seeds(seeds: DataFrame, path: str) -> None:
    write_tsv(seeds.select(F.col("seq_id").alias("Sequence ID"), F.array_join(F.array_sort("markers"), " ").alias("Marker IDs")), path, True, ["Sequence ID"])


def numbered(clusters: DataFrame, by: str = "cluster") -> DataFrame:
    """(by, number): clusters numbered from 1 by name, zero-padded to a width of
    ceil(log10(n + 1)). Clusters, not sequences, are in the one window."""
    names = clusters.select(by).distinct()
    n = F.count("*").over(Window.partitionBy())
    width = F.ceil(F.log10(n + 1)).cast("int")
    at = F.row_number().over(Window.orderBy(by)).cast("string")
    return names.select(by, F.lpad(at, F.greatest(width, F.length(at)), F.lit("0")).alias("number"))


def fasta_lines(seqs: DataFrame, width: int | None = None) -> DataFrame:
    """(cluster, value): each record as text, its body wrapped at `width`."""
    body = wrapped(F.col("seq"), width) if width else F.col("seq")
    return seqs.select("cluster", F.concat(F.lit(">"), "seq_id", F.lit("\n"), body).alias("value"))


def write_fasta(seqs: DataFrame, path: str, width: int | None = None) -> None:
    """A folder for each cluster; seqs: (cluster, seq_id, seq)."""
    fasta_lines(seqs, width).write.mode("overwrite").partitionBy("cluster").text(path)


def write_mapping(mapping: DataFrame, path: str) -> None:
    write_tsv(mapping.select(F.col("seq_id").alias("Sequence ID"), F.col("cluster_id").alias("Cluster ID")), path, order=["Cluster ID", "Sequence ID"])


def mapping_of(seqs: DataFrame, min_bp: int = 0) -> DataFrame:
    """(seq_id, cluster_id) of (file, seq_id, seq): files of at least `min_bp` bases,
    numbered by name; numbers go to kept files only."""
    size = seqs.groupBy("file").agg(F.sum(F.length("seq")).alias("bp")).where(F.col("bp") >= min_bp)
    return seqs.join(numbered(size, "file"), "file").select("seq_id", F.col("number").alias("cluster_id"))


def write_abundance(values: DataFrame, path: str, samples: list[str]) -> None:
    write_tsv(wide(values, ["node"], "sample", "value", samples).withColumnRenamed("node", "Classification"), path, order=["Classification"])


def write_variants(variants: DataFrame, path: str, samples: list[str]) -> None:
    """One column a sample: a/c/g/t, or NA."""
    calls = [shown(F.try_element_at("calls", F.lit(s))).alias(s) for s in samples]
    df = variants.select(F.col("classification").alias("Classification"), F.col("chrom").alias("Chromosome"), F.col("pos").alias("Position"), shown(F.col("population")).alias("Population"), *calls)
    write_tsv(df, path, order=["Classification", "Chromosome", "Position"])


def write_grid(grid: DataFrame, path: str, keys: list[str], column: str) -> None:
    """A threshold grid with one column a threshold."""
    write_tsv(grid.groupBy(*keys).pivot(column).agg(F.first("clusters")), path, order=keys)


def write_associations(tests: DataFrame, path: str) -> None:
    names = {"classification": "Classification", "chrom": "Chromosome", "pos": "Position", "allele": "Allele", "beta": "Beta", "se": "SE", "p": "P", "significance": "Significance"}
    df = tests.withColumn("allele", F.substring(F.lit("ACGT"), F.col("allele") + 1, F.lit(1))) if dict(tests.dtypes)["allele"] == "int" else tests
    write_tsv(df.select(*(F.col(a).alias(b) for a, b in names.items())), path, order=["Classification", "Chromosome", "Position"])


def merge_reports(*reports: DataFrame) -> DataFrame:
    """Reports of one kind under one header; columns that one lacks are null."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out
