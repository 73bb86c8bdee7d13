"""Tab-separated reports: fixed columns by position, or one or two columns a sample.

All are read through `sniffed_lines`, so gzip is told by content, repeated header
names do no harm, and `NA` of any case is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import read_lines


def _fields(line: str = "value") -> Column:
    return F.split(F.col(line), "\t", -1)


def _value(c: Column, kind: str) -> Column:
    return c if kind == "string" else F.when(F.lower(c) != "na", c).cast(kind)


def read_tsv(spark: SparkSession, path: str | list[str], columns: dict[str, str], header: str | tuple[str, ...] | None = None, skip: int = 1) -> DataFrame:
    """The first columns of a file with one header line. `header`: what the first
    line must start with; the read fails if it doesn't."""
    lines = read_lines(spark, path)
    if header:
        allowed = (header,) if isinstance(header, str) else header
        good = F.lit(False)
        for h in allowed:
            good = good | F.col("value").startswith(h)
        # one condition: of two, the one that drops the header could go first
        checked = F.when((F.col("line_no") == 0) & ~good, F.raise_error(F.concat(F.lit("unexpected header: "), "value")).cast("boolean")).otherwise(F.lit(False))
    else:
        checked = F.lit(False)
    rows = lines.where(F.when(F.col("line_no") < skip, checked).otherwise(F.col("value") != "")).withColumn("f", _fields())
    return rows.select(*(_value(F.get("f", F.lit(i)), kind).alias(name) for i, (name, kind) in enumerate(columns.items())))


def read_samples(spark: SparkSession, path: str, keys: dict[str, str], value: str = "value", kind: str = "double", per_sample: int = 1) -> DataFrame:
    """Long rows (keys, sample, value...) of a wide file: the first columns are
    keys, then each sample has `per_sample` columns. Sample names are the header's,
    or `sample<i>` where each has several."""
    lines = read_lines(spark, path)
    n = len(keys)
    head = F.broadcast(lines.where("line_no = 0").select("file", _fields().alias("h")))
    rows = lines.where("line_no > 0 and value <> ''").select("file", _fields().alias("f")).join(head, "file")
    at = F.sequence(F.lit(0), ((F.size("f") - n) / per_sample).cast("int") - 1)
    named = F.get("h", F.col("i") + n) if per_sample == 1 else F.concat(F.lit("sample"), F.col("i") + 1)
    rows = rows.where(F.size("f") >= n + per_sample).select("f", "h", F.explode(at).alias("i"))
    names = [value] if per_sample == 1 else ["mean", "variance"][:per_sample]
    return rows.select(
        *(F.get("f", F.lit(i)).cast(k).alias(name) for i, (name, k) in enumerate(keys.items())), named.alias("sample"),
        *(_value(F.get("f", F.col("i") * per_sample + (n + j)), kind).alias(name) for j, name in enumerate(names)),
    )


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, sample, mean, variance)."""
    return read_samples(spark, path, {"seq_id": "string"}, per_sample=2)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, markers)."""
    df = read_tsv(spark, path, {"seq_id": "string", "markers": "string"}, "Sequence ID\tMarker IDs")
    return df.select("seq_id", F.split("markers", " ").cast("array<int>").alias("markers"))


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, classification)."""
    return read_tsv(spark, path, {"cluster_id": "string", "classification": "string"}, "Cluster ID\tClassification")


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    """(name, completeness, contamination) in percent."""
    return read_tsv(spark, path, {"name": "string", "completeness": "double", "contamination": "double"}, "Name\tCompleteness\tContamination")


def passing_quality(quality: DataFrame, contamination: float = 0.10, completeness: float = 0.70) -> DataFrame:
    return quality.where((F.col("contamination") <= 100 * contamination) & (F.col("completeness") >= 100 * completeness))


def split_program(quality: DataFrame, combined: str | None = None) -> DataFrame:
    """(dataset, program, cluster, completeness, contamination in fractions) of names
    `Dataset.Program.ClusterID`; fails on others. `combined` names all datasets."""
    pattern = r"^([^.]+)\.(.+)\.([^.]+)$"
    part = lambda i: F.regexp_extract("name", pattern, i)
    ok = F.when(~F.col("name").rlike(pattern), F.raise_error(F.concat(F.lit("not Dataset.Program.ClusterID: "), "name"))).otherwise(F.lit(True))
    return quality.where(ok).select((F.lit(combined) if combined else part(1)).alias("dataset"), part(2).alias("program"), part(3).alias("cluster"), (F.col("completeness") / 100).alias("completeness"), (F.col("contamination") / 100).alias("contamination"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(name, classification, genus, species); rows whose genus is empty are dropped."""
    df = read_tsv(spark, path, {"name": "string", "classification": "string"}, "user_genome\tclassification")
    return with_genus(df)


def with_genus(df: DataFrame) -> DataFrame:
    """Splits `classification` into the path to the genus and the species."""
    df = df.withColumns({"genus": F.regexp_extract("classification", r"^(.*);[^;]*$", 1), "species": F.regexp_extract("classification", r"([^;]*)$", 1)})
    return df.where((F.col("genus") != "") & ~F.col("genus").endswith("g__"))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, cluster_id), of either header."""
    return read_tsv(spark, path, {"seq_id": "string", "cluster_id": "string"}, ("Sequence ID\tCluster ID", "Sequence ID\tCluster"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, genome_id, length)."""
    return read_tsv(spark, path, {"seq_id": "string", "genome_id": "string", "length": "long"}, "Sequence ID\tGenome ID\tLength")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(sample, grp)."""
    return read_tsv(spark, path, {"sample": "string", "grp": "string"}, "ID\tGroup")


def read_abundance(spark: SparkSession, path: str) -> DataFrame:
    """(classification, sample, value)."""
    return read_samples(spark, path, {"classification": "string"})


def read_phenotype(spark: SparkSession, path: str, column: int = 2) -> DataFrame:
    """(sample, phenotype): the chosen column, counted from 1; NA is null."""
    kinds = {"sample": "string"} | {f"_{i}": "string" for i in range(2, column)} | {"phenotype": "double"}
    return read_tsv(spark, path, kinds).select("sample", "phenotype")


def read_covariates(spark: SparkSession, path: str) -> DataFrame:
    """(sample, name, value): a field that is NA is null, and only it."""
    df = read_samples(spark, path, {"sample_id": "string"})
    return df.select(F.col("sample_id").alias("sample"), F.col("sample").alias("name"), "value")


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """(classification, chrom, pos, population, sample, acgt): frequencies as arrays;
    acgt is null for NA."""
    keys = {"classification": "string", "chrom": "string", "pos": "long", "population": "string"}
    df = read_samples(spark, path, keys, "acgt", "string")
    quad = lambda c: F.when(F.lower(c) != "na", F.split(c, "/").cast("array<double>"))
    return df.select("classification", "chrom", "pos", quad(F.col("population")).alias("population"), "sample", quad(F.col("acgt")).alias("acgt"))


def read_associations(spark: SparkSession, path: str) -> DataFrame:
    kinds = {"classification": "string", "chrom": "string", "pos": "long", "allele": "string", "beta": "double", "se": "double", "p": "double", "significance": "string"}
    return read_tsv(spark, path, kinds, "Classification\tChromosome\tPosition\tAllele")


def read_variant_annotation(spark: SparkSession, path: str) -> DataFrame:
    kinds = {"classification": "string", "chrom": "string", "pos": "long", "annotation": "string"}
    return read_tsv(spark, path, kinds, "Classification\tChromosome\tPosition\tAnnotation")


def read_pairs(spark: SparkSession, path: str, ani: float | None = None, header: bool = False) -> DataFrame:
    """(src, dst), both ways, of a list of similar files; `ani`: least value of the
    third column, for lists that are not cut already."""
    kinds = {"src": "string", "dst": "string"} | ({"ani": "double"} if ani is not None else {})
    df = read_tsv(spark, path, kinds, skip=int(header))
    if ani is not None:
        df = df.where(F.col("ani") >= ani)
    df = df.where("src <> dst").select("src", "dst")
    return df.union(df.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
