"""The whole workflows, from files to files: one function for each command.

Each checks its parameters, reads, composes the operators and writes folders of part
files; each also returns the table that it wrote. Gene finding, profile search, quality
estimation and taxonomy are programs outside this library: their reports come in as
files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .functions import stats
from .functions.sequence import kmer_profile, nx
from .operators import abundance as ab
from .operators import assoc, binning, clustering, dereplicate, graph, intervals, markers, pileup, taxonomy
from .sources import bam, fasta, files, profiles, tables


def _share(**named: float) -> None:
    for name, v in named.items():
        if not 0 <= v <= 1:
            raise ValueError(f"{name} must be between 0 and 1: {v}")


def _some(**named) -> None:
    for name, v in named.items():
        if not v:
            raise ValueError(f"{name} must not be empty")


def with_samples(reads: DataFrame, suffix: str = ".bam") -> DataFrame:
    """Adds `sample`, by the name of the file."""
    return reads.withColumn("sample", files.stem(F.col("file"), suffix))


def _sequences(index: DataFrame) -> DataFrame:
    return index.select("name", "length").distinct()


def index_bam(spark: SparkSession, bams: list[str], output: str | None = None) -> DataFrame:
    """The byte ranges of each reference in each file; kept as Parquet with `output`."""
    _some(bams=bams)
    index = bam.build_index(spark, bams)
    if not output:
        return index
    index.write.mode("overwrite").parquet(output)
    return spark.read.parquet(output)


def coverage(spark: SparkSession, bams: list[str], output: str, index: DataFrame | None = None, min_length: int = 100, trim: int = 0, mapq: int | None = None, identity: float = 0.9, long: bool = False) -> DataFrame:
    """Mean and variance of depth of every sequence in every sample; `long` reads are
    not held to an identity; without `mapq` the floor follows the number of sequences."""
    _share(identity=identity)
    ranges = bam.checked_index(index if index is not None else index_bam(spark, bams))
    sequences = _sequences(ranges)
    floor = intervals.mapq_for(sequences.count()) if mapq is None else mapq
    reads = with_samples(bam.read_bam(ranges, min_length, columns=bam.PLACED))
    samples = with_samples(ranges.select("file").distinct()).select("sample").distinct()
    found = intervals.coverage(reads, sequences, floor, 0.0 if long else identity, trim, min_length, samples)
    sinks.write_coverage(found, output, sorted(r["sample"] for r in samples.collect()))
    return found


def seed(spark: SparkSession, hits: list[str], database: str | None, output: str) -> DataFrame:
    """Markers of sequences from the hit tables of a profile search; with the profile
    database, hits under their profile's threshold are left out."""
    _some(hits=hits)
    rows = profiles.read_hits(spark, hits)
    if database:
        limits = profiles.read_profiles(spark, database).select("profile", F.col("sequence_score").alias("threshold"))
        rows = markers.above_threshold(rows, limits)
    # hits of a protein are in one file: its line keeps their order
    found = markers.seeds(rows.withColumn("ordinal", F.col("ordinal.line_no")), markers.profile_table(spark))
    sinks.write_seeds(found, output)
    return found


def cluster(spark: SparkSession, assembly: str, coverage_file: str, seed_file: str, output: str, folder: str, min_length: int | None = None, settings: clustering.Settings | None = None) -> DataFrame:
    """Clusters of an assembly: FASTA and mapping under `output`. `folder` is a shared
    place for the state of the rounds."""
    cov = tables.read_coverage(spark, coverage_file)
    samples = cov.select("sample").distinct().count()
    least = min_length if min_length is not None else (1000 if samples <= 1 else 500)
    marks = tables.read_seeds(spark, seed_file)
    seqs = fasta.read_fasta(spark, assembly).select("seq_id", "seq", F.length("seq").cast("long").alias("length"))
    seqs = seqs.join(marks.select("seq_id").distinct().withColumn("seed", F.lit(True)), "seq_id", "left").where((F.col("length") >= least) | F.col("seed"))
    wide = cov.groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "mean", "variance"))), lambda s: F.struct(s["mean"], s["variance"])).alias("c"))
    none = F.array_repeat(F.lit(0.0), samples)
    features = kmer_profile(seqs).join(seqs.select("seq_id", "length"), "seq_id").join(wide, "seq_id", "left").select(
        "seq_id", "length", "profile", F.coalesce(F.transform("c", lambda s: s["mean"]), none).alias("mean"),
        F.transform(F.coalesce(F.transform("c", lambda s: s["variance"]), none), lambda v: graph.shrunk(v, max(samples, 1))).alias("variance"),
    )
    # ids by falling length, the longest first
    ids = _numbered(features.select("seq_id", "length"), folder)
    # a seed that the assembly lacks fails
    marked = binning.strict_join(marks, ids, "seq_id", "seed that is not in the assembly").select("id", "markers")
    found = clustering.cluster_sequences(features.join(ids, "seq_id").drop("seq_id"), marked, folder, settings)
    named = found.join(sinks.numbered(found.select(F.col("cluster").alias("cluster")), "cluster"), "cluster").join(ids.select("id", "seq_id"), "id").select("seq_id", F.col("number").alias("cluster_id"))
    named = graph._written(named, folder, "mapping")
    sinks.write_mapping(named, f"{output}/mapping")
    sinks.write_fasta(seqs.join(named, "seq_id").select(F.col("cluster_id").alias("cluster"), "seq_id", "seq"), f"{output}/fasta")
    return named


def _numbered(rows: DataFrame, folder: str) -> DataFrame:
    """(seq_id, id): ids from 0 by falling length, then name, from range partitions."""
    from pyspark.sql import Window

    spread = rows.repartitionByRange(F.desc("length"), F.asc("seq_id")).withColumn("part", F.spark_partition_id())
    spread = graph._written(spread, folder, "ranges")
    before = spread.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("length"), "seq_id")) - 1
    return graph._written(spread.withColumn("r", own).join(F.broadcast(before), "part").select("seq_id", (F.col("ahead") + F.col("r")).alias("id")), folder, "ids")


def cluster2mapping(spark: SparkSession, clusters: list[str], output: str, min_bp: int = 0) -> DataFrame:
    """The mapping of sequences to numbered clusters, from a FASTA file for each."""
    _some(clusters=clusters)
    found = sinks.mapping_of(fasta.read_fasta(spark, clusters), min_bp)
    sinks.write_mapping(found, output)
    return found


def mapping2cluster(spark: SparkSession, assembly: str, mapping: str, output: str, quality: str | None = None, contamination: float = 0.10, completeness: float = 0.70, min_bp: int = 0) -> DataFrame:
    """A FASTA folder for each cluster of a mapping, of those of passing quality; a
    mapped sequence that the assembly lacks fails."""
    _share(contamination=contamination, completeness=completeness)
    m = tables.read_mapping(spark, mapping)
    if quality:
        passing = tables.passing_quality(tables.read_quality(spark, quality), contamination, completeness)
        m = m.join(passing.select(F.col("name").alias("cluster_id")), "cluster_id", "left_semi")
    rows = binning.strict_join(m, fasta.read_fasta(spark, assembly).select("seq_id", "seq"), "seq_id").select(F.col("cluster_id").alias("cluster"), "seq_id", "seq")
    kept = rows.groupBy("cluster").agg(F.sum(F.length("seq")).alias("bp")).where(F.col("bp") >= min_bp).select("cluster")
    rows = rows.join(kept, "cluster", "left_semi")
    sinks.write_fasta(rows, output, 100)
    return rows


def benchmark_gt(spark: SparkSession, truth: str, mappings: dict[str, str], output: str, precision: tuple[float, ...] = (0.95, 0.90), recall: tuple[float, ...] = (0.95, 0.90, 0.80, 0.70)) -> DataFrame:
    """Clusters of each program at or above thresholds of precision and recall against
    the truth, with the parts of stacked bars."""
    _some(mappings=mappings)
    t = tables.read_truth(spark, truth)
    grids = []
    for label, path in mappings.items():
        scores = binning.best_match(binning.contingency(tables.read_mapping(spark, path), t), binning.genome_lengths(t))
        grids.append(binning.threshold_grid(scores, spark, list(recall), list(precision)).withColumn("program", F.lit(label)))
    out = binning.stacked(sinks.merge_reports(*grids), ["program", "precision_t"], "recall_t")
    sinks.write_grid(out, output, ["program", "precision_t"], "recall_t")
    return out


def benchmark_rw(spark: SparkSession, quality: str, output: str, contamination: tuple[float, ...] = (0.05, 0.10), completeness: tuple[float, ...] = (0.95, 0.90, 0.80, 0.70), combined: str | None = None, labels: dict[str, str] | None = None) -> DataFrame:
    """Clusters of each dataset and program at thresholds of quality."""
    scores = tables.split_program(tables.read_quality(spark, quality), combined)
    grid = binning.quality_grid(scores, list(contamination), list(completeness))
    out = binning.stacked(binning.labelled(grid, spark, labels or {}), ["dataset", "program", "contamination_t"], "completeness_t")
    sinks.write_grid(out, output, ["dataset", "label", "contamination_t"], "completeness_t")
    return out


def representative(spark: SparkSession, clusters: list[str], quality: str, classification: str, output: str, pairs: str | None = None, contamination: float = 0.10, completeness: float = 0.70, ani: float = 0.95, k: int = 21, sketch: int = 5000, suffix: str = ".fasta") -> DataFrame:
    """The representatives and their renumbered sequences. Unnamed clusters are compared
    by MinHash inside a genus, or by the list `pairs` of an outside program."""
    _share(contamination=contamination, completeness=completeness, ani=ani)
    seqs = fasta.read_fasta(spark, clusters).withColumn("name", files.stem(F.col("file"), suffix))
    n50 = nx(seqs.select("name", F.length("seq").alias("length")), ["name"]).withColumnRenamed("nx", "n50")
    passing = tables.passing_quality(tables.read_quality(spark, quality), contamination, completeness)
    rows = dereplicate.candidates(n50, passing, tables.read_taxonomy(spark, classification))
    scored = rows.withColumn("score", dereplicate.cluster_score(F.col("completeness"), F.col("contamination"), F.col("n50")))
    if pairs:
        near = tables.read_pairs(spark, pairs).select(files.stem(F.col("src"), suffix).alias("src"), files.stem(F.col("dst"), suffix).alias("dst"))
    else:
        unnamed = scored.where("species = 's__'").select("genus").distinct()
        wanted = seqs.join(scored.join(unnamed, "genus", "left_semi").select("name"), "name", "left_semi")
        near = dereplicate.similar_pairs(dereplicate.sketches(wanted, "name", k, sketch), "name", k, sketch, ani, scored.select("name", "genus")).select("src", "dst")
    found = dereplicate.representatives(scored, near)
    sinks.write_tsv(found.select(F.col("cluster_id").alias("Cluster ID"), F.col("classification").alias("Classification")), f"{output}/annotation", order=["Cluster ID"])
    named = dereplicate.renumbered(seqs.select("name", "ordinal", "seq"), found)
    named.select(F.concat(F.lit(">"), "seq_id", F.lit("\n"), "seq").alias("value")).write.mode("overwrite").text(f"{output}/assembly")
    return found


def abundance(spark: SparkSession, bams: list[str], annotation: str, output: str, index: DataFrame | None = None, mapq: int = 0, identity: float = 0.9, trim: int = 0, min_depth: float = 0.1, long: bool = False) -> DataFrame:
    """The relative abundance of every taxon in every sample."""
    _share(identity=identity)
    whole = index if index is not None else index_bam(spark, bams)
    ranges = bam.checked_index(whole)
    placed = bam.read_bam(ranges, columns=bam.PLACED)
    ann = tables.read_annotation(spark, annotation)
    reads = with_samples(placed).unionByName(with_samples(_unplaced(whole)))
    found = ab.abundance(reads, _sequences(ranges), ann, mapq, 0.0 if long else identity, trim, min_depth)
    sinks.write_abundance(found, output, sorted(r["sample"] for r in with_samples(ranges.select("file").distinct()).collect()))
    return found


def _unplaced(index: DataFrame) -> DataFrame:
    """Reads on no reference."""
    return bam.read_bam(index.where("ref_id = -1").withColumn("ref_id", F.lit(0)), columns=bam.PLACED).withColumn("name", F.lit(None).cast("string"))


def abundance_test(spark: SparkSession, abundances: str, groups: str, output: str, ranks: tuple[str, ...] = ("s",), prevalence: float = 0.5, method: str = "bonferroni", pair: tuple[str, str] | None = None) -> DataFrame:
    """Rank tests of each taxon between groups of samples."""
    _share(prevalence=prevalence)
    values = tables.read_abundance(spark, abundances).withColumnRenamed("classification", "node")
    values = ab.log_abundance(taxonomy.of_ranks(values, list(ranks)))
    found = stats.group_test(values, tables.read_groups(spark, groups), -5.0, prevalence, method, pair)
    sinks.write_tsv(found, output, order=["group1", "group2", "q", "node"])
    return found


def variant(spark: SparkSession, bams: list[str], annotation: str, output: str, index: DataFrame | None = None, mapq: int = 0, identity: float = 0.9, depth: int = 1, coverage: float = 0.5) -> DataFrame:
    """Variable sites with each sample's allele frequencies."""
    _share(identity=identity, coverage=coverage)
    ranges = bam.checked_index(index if index is not None else index_bam(spark, bams))
    names = sorted(r["sample"] for r in with_samples(ranges.select("file").distinct()).collect())
    found = pileup.variants(with_samples(bam.read_bam(ranges)), tables.read_annotation(spark, annotation), len(names), mapq, identity, depth, coverage)
    sinks.write_variants(found, output, names)
    return found


def mwas(spark: SparkSession, variants: str, abundances: str, phenotype: str, output: str, covariates: str | None = None, prior: str | None = None, column: int = 2, components: int = 5, size: float = 0.5, alpha: float = 0.05) -> DataFrame:
    """Association of each variant with a phenotype; `prior`: associations to replicate.

    Samples are as many as the study has: their distances, phenotypes and covariates are
    driver-side; variants are not."""
    _share(size=size, alpha=alpha)
    rows = tables.read_variants(spark, variants)
    calls = assoc.usable(rows, tables.read_abundance(spark, abundances)).withColumn("allele", assoc.allele_of(F.col("population")))
    distance = assoc.sample_distance(calls.withColumn("f", F.get("acgt", F.col("allele"))), ["classification", "chrom", "pos"]).toPandas()
    extra = tables.read_covariates(spark, covariates) if covariates else None
    cases = {r["sample"]: r["phenotype"] for r in assoc.complete_cases(tables.read_phenotype(spark, phenotype, column), extra).join(rows.select("sample").distinct(), "sample", "left_semi").collect()}
    names = sorted(cases)
    import numpy as np

    parts = [assoc.principal_components(distance, names, components)]
    if extra is not None:
        wide = {}
        for r in extra.orderBy("name").collect():
            wide.setdefault(r["sample"], []).append(r["value"])
        parts.insert(0, np.array([wide[s] for s in names]))
    x = assoc.scaled(np.column_stack(parts))
    if prior:
        alleles = F.instr(F.lit("ACGT"), F.col("allele")) - 1
        calls = assoc.prior_alleles(calls, tables.read_associations(spark, prior).withColumn("allele", alleles.cast("int")))
    calls = calls.select("classification", "chrom", "pos", "allele", "sample", F.get("acgt", F.col("allele")).alias("f"), "abundance")
    found = assoc.significance(assoc.glm(calls, cases, {s: x[i].tolist() for i, s in enumerate(names)}, size), alpha, prior is not None)
    sinks.write_associations(found, output)
    return found


def plot_mwas(spark: SparkSession, associations: str, output: str, annotation: str | None = None, most: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """The points of the QQ and the Manhattan plot."""
    tests = tables.read_associations(spark, associations)
    layout = assoc.manhattan(tests, most)
    if annotation:
        layout = assoc.annotate(layout, tables.read_variant_annotation(spark, annotation))
    points = assoc.qq_points(tests, most=most)
    sinks.write_tsv(points, f"{output}/qq", order=["p"])
    sinks.write_tsv(layout, f"{output}/manhattan", order=["x"])
    return points, layout


def checkm2(spark: SparkSession, reports: list[str], output: str, contamination: float = 0.10, completeness: float = 0.70) -> DataFrame:
    """Passing rows of the quality reports of an outside estimator, under one header."""
    _some(reports=reports)
    _share(contamination=contamination, completeness=completeness)
    found = tables.passing_quality(sinks.merge_reports(*(tables.read_quality(spark, r) for r in reports)), contamination, completeness)
    sinks.write_tsv(found, output, order=["name"])
    return found


def gtdbtk(spark: SparkSession, reports: list[str], output: str, quality: str | None = None) -> DataFrame:
    """The taxonomy reports (one for each domain) of an outside classifier, under one
    header, of clusters of passing quality."""
    _some(reports=reports)
    kinds = {"name": "string", "classification": "string"}
    found = sinks.merge_reports(*(tables.read_tsv(spark, r, kinds, "user_genome\tclassification") for r in reports))
    if quality:
        found = found.join(tables.passing_quality(tables.read_quality(spark, quality)), "name", "left_semi")
    sinks.write_tsv(found.select(F.col("name").alias("user_genome"), "classification"), output, order=["user_genome"])
    return found
