"""Sources and sinks: what a writer or a program wrote, read back. Files are made from the
tables, so SQL over these says what has to come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..operators import abundance as ab
from ..operators import binning, intervals, pileup, taxonomy
from ..sources import bam, fasta, files, profiles, tables
from . import samples
from .base import Plans, scratch, table
from .sequences import BASES, LETTERS

PLANS = Plans()
_SEQS = f"seqs AS (SELECT doc_id, coalesce(lang, 'none') AS cluster, regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGT]', '', 'g') AS seq FROM documents WHERE text IS NOT NULL)"


def _seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.coalesce("lang", F.lit("none")).alias("cluster"), F.regexp_replace(F.translate("text", LETTERS, BASES), "[^ACGT]", "").alias("seq")).where("seq <> ''")


def _lines(spark: SparkSession, rows: DataFrame, label: str, *head: str, zipped: bool = False) -> list[str]:
    """Files of `rows` (value), each under the header lines."""
    folder = scratch(spark, label)
    if head:
        rows.write.option("header", True).option("sep", "\x01").option("quote", "").option("compression", "gzip" if zipped else "none").csv(folder)
    else:
        rows.write.option("compression", "gzip" if zipped else "none").text(folder)
    return files.part_files(spark, folder)


def _tsv(spark: SparkSession, rows: DataFrame, label: str, *names: str, zipped: bool = False) -> list[str]:
    folder = scratch(spark, label)
    sinks.write_tsv(rows.toDF(*names), folder, zipped)
    return files.part_files(spark, folder)


@PLANS.add(f"WITH {_SEQS} SELECT cluster, 's' || doc_id AS seq_id, length(seq)::BIGINT AS n, md5(seq) AS digest FROM seqs WHERE seq <> ''")
def fasta_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of FASTA a cluster, wrapped, gzip by content; the cluster is told by the folder."""
    folder = scratch(spark, "fasta")
    sinks.write_fasta(_seqs(spark, sf_dir).select("cluster", F.concat(F.lit("s"), "doc_id", F.lit(" a document")).alias("seq_id"), "seq"), folder, 100)
    found = [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path").collect()]
    rows = fasta.read_fasta(spark, found)
    return rows.select(F.regexp_extract("file", "cluster=([^/]*)/", 1).alias("cluster"), "seq_id", F.length("seq").cast("long").alias("n"), F.md5("seq").alias("digest"))


@PLANS.add(f"WITH {_SEQS} SELECT 's' || doc_id AS seq_id, length(seq)::BIGINT AS n, md5(seq) AS digest FROM seqs WHERE seq <> ''")
def fasta_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain files, which Spark splits at records."""
    rows = sinks.fasta_lines(_seqs(spark, sf_dir).select("cluster", F.concat(F.lit("s"), "doc_id").alias("seq_id"), "seq"), 100).select("value")
    folder = scratch(spark, "fasta")
    rows.write.text(folder)
    return fasta.read_plain_fasta(spark, folder).select("seq_id", F.length("seq").cast("long").alias("n"), F.md5("seq").alias("digest"))


@PLANS.add(f"WITH {_SEQS} SELECT 's' || doc_id AS seq_id, length(seq)::BIGINT AS n, md5(seq) AS digest FROM seqs WHERE seq <> ''")
def fasta_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _seqs(spark, sf_dir).select(F.concat(F.lit(">s"), "doc_id", F.lit("\n"), "seq").alias("value"))
    return fasta.read_fasta(spark, _lines(spark, rows, "fasta", zipped=True)).select("seq_id", F.length("seq").cast("long").alias("n"), F.md5("seq").alias("digest"))


@PLANS.add("""WITH c AS (SELECT l_suppkey AS k, l_returnflag AS f, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY ALL), s AS (SELECT DISTINCT k FROM c), g AS (SELECT * FROM (VALUES ('A', 'sample1'), ('N', 'sample2'), ('R', 'sample3')) t(f, sample))
SELECT k::VARCHAR AS seq_id, sample, round(m, 6) AS mean, round(v, 6) AS variance FROM s CROSS JOIN g LEFT JOIN c USING (k, f)""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("seq_id"), F.col("l_returnflag").alias("sample")).agg(F.avg("l_quantity").alias("mean"), F.var_samp("l_quantity").alias("variance"))
    folder = scratch(spark, "coverage")
    sinks.write_coverage(c, folder, ["A", "N", "R"])
    return tables.read_coverage(spark, files.part_files(spark, folder)).select("seq_id", "sample", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@PLANS.add("SELECT p_brand AS seq_id, string_agg(m::VARCHAR, ' ' ORDER BY m) AS markers FROM (SELECT DISTINCT p_brand, p_size % 120 AS m FROM part) GROUP BY 1")
def seed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("seq_id")).agg(F.collect_set((F.col("p_size") % 120).cast("int")).alias("markers"))
    folder = scratch(spark, "seeds")
    sinks.write_seeds(rows, folder)
    return tables.read_seeds(spark, files.part_files(spark, folder)).select("seq_id", F.array_join("markers", " ").alias("markers"))


@PLANS.add("""WITH f AS (SELECT coalesce(source, 'none') AS file, sum(coalesce(length(text), 0)) AS bp FROM documents GROUP BY 1 HAVING sum(coalesce(length(text), 0)) >= 5000), n AS (SELECT file, row_number() OVER (ORDER BY file)::VARCHAR AS i, ceil(log10(count(*) OVER () + 1))::INT AS w FROM f)
SELECT doc_id::VARCHAR AS seq_id, lpad(i, greatest(w, length(i))::INT, '0') AS cluster_id FROM documents JOIN n ON n.file = coalesce(source, 'none')""")
def mapping_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of enough bases, numbered; the mapping written and read."""
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("file"), F.col("doc_id").cast("string").alias("seq_id"), F.coalesce("text", F.lit("")).alias("seq"))
    folder = scratch(spark, "mapping")
    sinks.write_mapping(sinks.mapping_of(d, 5000), folder)
    return tables.read_mapping(spark, files.part_files(spark, folder))


@PLANS.add("SELECT node, count(*) AS n FROM (SELECT DISTINCT unnest(['d__' || r_name, 'd__' || r_name || ';g__' || n_name, 'd__' || r_name || ';g__' || n_name || ';s__' || c_mktsegment]) AS node, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey) GROUP BY 1")
def annotation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters at and under each node of an annotation file."""
    rows = _paths(spark, sf_dir).select("cluster", "path")
    read = tables.read_annotation(spark, _tsv(spark, rows, "annotation", "Cluster ID", "Classification"))
    return read.select("cluster_id", F.explode(taxonomy.prefixes(F.col("classification"))).alias("node")).groupBy("node").agg(F.count_distinct("cluster_id").alias("n"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.concat(F.lit("c"), "c_custkey").alias("cluster"), F.concat(F.lit("d__"), "r_name", F.lit(";g__"), "n_name", F.lit(";s__"), "c_mktsegment").alias("path"), "c_acctbal", "c_nationkey", "c_custkey")


@PLANS.add("""SELECT c_mktsegment AS dataset, 'p.' || c_nationkey AS program, c_custkey::VARCHAR AS cluster, round((c_custkey % 101)::DOUBLE / 100, 9) AS completeness, round((c_custkey % 13)::DOUBLE / 100, 9) AS contamination
FROM customer WHERE c_custkey % 13 <= 10 AND c_custkey % 101 >= 70""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passing rows of a quality file, their names split."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.concat("c_mktsegment", F.lit(".p."), "c_nationkey", F.lit("."), "c_custkey").alias("a"), (F.col("c_custkey") % 101).cast("double").alias("b"), (F.col("c_custkey") % 13).cast("double").alias("c"), F.lit("more").alias("d"))
    read = tables.passing_quality(tables.read_quality(spark, _tsv(spark, rows, "quality", "Name", "Completeness", "Contamination", "Note")))
    return tables.split_program(read).select("dataset", "program", "cluster", F.round("completeness", 9).alias("completeness"), F.round("contamination", 9).alias("contamination"))


@PLANS.add("SELECT 'o' || o_custkey AS genome_id, sum(o_orderkey)::BIGINT AS genome_bp FROM orders GROUP BY 1")
def truth_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), "o_orderkey"), F.concat(F.lit("o"), "o_custkey"), "o_orderkey")
    return binning.genome_lengths(tables.read_truth(spark, _tsv(spark, o, "truth", "Sequence ID", "Genome ID", "Length")))


@PLANS.add("SELECT 'c' || c_custkey AS sample, c_mktsegment AS grp FROM customer")
def group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey"), "c_mktsegment")
    return tables.read_groups(spark, _tsv(spark, c, "groups", "ID", "Group"))


@PLANS.add("""WITH v AS (SELECT 'g__' || l_suppkey || ';s__x' AS node, l_returnflag AS sample, sum(l_discount) / 100 AS value FROM lineitem GROUP BY ALL), s AS (SELECT DISTINCT sample FROM v), n AS (SELECT DISTINCT node FROM v)
SELECT node AS classification, sample, round(log10(least(1, greatest(1e-5, value))), 6) AS value FROM n CROSS JOIN s LEFT JOIN v USING (node, sample) WHERE value IS NOT NULL""")
def abundance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide file of taxa and samples, read by rank, on the logarithmic scale."""
    v = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("g__"), "l_suppkey", F.lit(";s__x")).alias("node"), F.col("l_returnflag").alias("sample")).agg((F.sum("l_discount") / 100).alias("value"))
    v = v.unionByName(v.select(F.regexp_replace("node", ";.*", "").alias("node"), "sample", "value"))
    folder = scratch(spark, "abundance")
    sinks.write_abundance(v, folder, ["A", "N", "R"])
    read = taxonomy.of_ranks(tables.read_abundance(spark, files.part_files(spark, folder)), ["s"], "classification")
    return ab.log_abundance(read.where("value is not null")).select("classification", "sample", F.round("value", 6).alias("value"))


@PLANS.add("SELECT c_custkey::VARCHAR AS sample, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS phenotype FROM customer")
def phenotype_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third column of a phenotype file; NA in any case is missing."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 14 == 0, "nA").when(F.col("c_custkey") % 7 == 0, "NA").otherwise(F.col("c_acctbal").cast("string")))
    return tables.read_phenotype(spark, _tsv(spark, c, "phenotype", "ID", "X", "Y"), 3)


@PLANS.add("SELECT c_custkey::VARCHAR AS sample, name, value FROM (SELECT c_custkey, 'nation' AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey::DOUBLE END AS value FROM customer UNION ALL SELECT c_custkey, 'balance', c_acctbal FROM customer)")
def covariate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")), "c_acctbal")
    return tables.read_covariates(spark, _tsv(spark, c, "covariates", "ID", "nation", "balance"))


_CALLS = "q AS (SELECT l_suppkey AS k, l_partkey % 50 AS pos, l_returnflag AS sample, count(*) FILTER (l_linenumber % 4 = 0) AS a, count(*) FILTER (l_linenumber % 4 = 1) AS c, count(*) FILTER (l_linenumber % 4 = 2) AS g, count(*) FILTER (l_linenumber % 4 = 3) AS t, count(*) AS n FROM lineitem GROUP BY ALL)"


@PLANS.add(f"""WITH {_CALLS}, s AS (SELECT k, pos, sum(a)::DOUBLE AS a, sum(c)::DOUBLE AS c, sum(g)::DOUBLE AS g, sum(t)::DOUBLE AS t, sum(n)::DOUBLE AS n FROM q GROUP BY ALL), m AS (SELECT * FROM (VALUES ('A'), ('N'), ('R')) t(sample))
SELECT 'd__' || k AS classification, 's' || k AS chrom, s.pos::BIGINT AS pos, round(s.a / s.n, 4) AS major, sample, round(q.c::DOUBLE / q.n, 4) AS f FROM s CROSS JOIN m LEFT JOIN q USING (k, pos, sample)""")
def variant_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of sites and samples written as a/c/g/t or NA, and read."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 50).alias("pos"), F.col("l_returnflag").alias("sample"), (F.col("l_linenumber") % 4).alias("b"))
    share = lambda: F.array(*(F.count_if(F.col("b") == i) / F.count("*") for i in range(4)))
    calls = lines.groupBy("k", "pos", "sample").agg(share().alias("f")).groupBy("k", "pos").agg(F.map_from_entries(F.collect_list(F.struct("sample", "f"))).alias("calls"))
    rows = lines.groupBy("k", "pos").agg(share().alias("population")).join(calls, ["k", "pos"]).select(F.concat(F.lit("d__"), "k").alias("classification"), F.concat(F.lit("s"), "k").alias("chrom"), "pos", "population", "calls")
    folder = scratch(spark, "variants")
    sinks.write_variants(rows, folder, ["A", "N", "R"])
    read = tables.read_variants(spark, files.part_files(spark, folder))
    return read.select("classification", "chrom", "pos", F.col("population")[0].alias("major"), "sample", F.get("acgt", F.lit(1)).alias("f"))


_TESTS = "t AS (SELECT 'd__' || s_nationkey AS classification, 's' || s_suppkey AS chrom, s_suppkey * 3 AS pos, s_suppkey % 4 AS allele, round(s_acctbal / 1000, 3) AS beta, (s_suppkey % 97)::DOUBLE / 1000 AS p FROM supplier)"


@PLANS.add(f"WITH {_TESTS} SELECT classification, chrom, pos::BIGINT AS pos, ('ACGT')[(allele + 1)::INT] AS allele, beta, p, CASE WHEN p > 0.05::DOUBLE / (SELECT count(*) FROM t) THEN '-' ELSE '+' END AS significance FROM t")
def association_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import assoc

    s = table(spark, sf_dir, "supplier")
    rows = s.select(F.concat(F.lit("d__"), "s_nationkey").alias("classification"), F.concat(F.lit("s"), "s_suppkey").alias("chrom"), (F.col("s_suppkey") * 3).alias("pos"), (F.col("s_suppkey") % 4).cast("int").alias("allele"), F.round(F.col("s_acctbal") / 1000, 3).alias("beta"), F.lit(1.0).alias("se"), ((F.col("s_suppkey") % 97).cast("double") / 1000).alias("p"))
    folder = scratch(spark, "associations")
    sinks.write_associations(assoc.significance(rows), folder)
    return tables.read_associations(spark, files.part_files(spark, folder)).drop("se")


@PLANS.add("SELECT 's' || s_suppkey AS chrom, (s_suppkey * 3)::BIGINT AS pos, s_name AS annotation FROM supplier")
def variant_annotation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.lit("d"), F.concat(F.lit("s"), "s_suppkey"), F.col("s_suppkey") * 3, "s_name")
    return tables.read_variant_annotation(spark, _tsv(spark, s, "annotations", "Classification", "Chromosome", "Position", "Annotation")).select("chrom", "pos", "annotation")


@PLANS.add("""SELECT CASE WHEN p_partkey % 2 = 0 THEN 'PF' ELSE 'TIGR' END || lpad(p_partkey::VARCHAR, 5, '0') AS profile, p_size::INT AS length, CASE WHEN p_partkey % 2 = 0 THEN p_size + 0.5::DOUBLE ELSE p_size + 1.5::DOUBLE END AS sequence_score, CASE WHEN p_partkey % 2 = 0 THEN p_size - 0.5::DOUBLE ELSE p_size - 1.5::DOUBLE END AS domain_score FROM part""")
def profile_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of a profile database: one kind's gathering, the other's trusted cut-offs."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "PF").otherwise("TIGR"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"))
    text = F.concat(F.lit("NAME  x\nACC   "), name, F.lit("\nLENG  "), "p_size", F.lit("\nGA    "), F.col("p_size") + 0.5, F.lit(" "), F.col("p_size") - 0.5, F.lit(";\nTC    "), F.col("p_size") + 1.5, F.lit(" "), F.col("p_size") - 1.5, F.lit(";\nHMM\n//"))
    folder = scratch(spark, "profiles")
    p.select(text.alias("value")).write.text(folder)
    return profiles.read_profiles(spark, folder)


@PLANS.add("SELECT 'p' || l_orderkey AS protein, CASE WHEN l_linenumber % 2 = 0 THEN 'PF' || l_partkey ELSE 'q' || l_partkey END AS profile, l_quantity AS score, count(*) AS n FROM lineitem GROUP BY ALL")
def hit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    text = F.concat_ws("   ", F.concat(F.lit("p"), "l_orderkey"), F.lit("-"), F.concat(F.lit("q"), "l_partkey"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("PF"), "l_partkey")).otherwise("-"), F.lit("1e-9"), "l_quantity", F.lit("0.1"))
    rows = line.select(F.explode(F.array(F.lit("# a comment"), text)).alias("value"))
    return profiles.read_hits(spark, _lines(spark, rows, "hits")).groupBy("protein", "profile", "score").agg(F.count("*").alias("n"))


@PLANS.add("SELECT 'p' || l_orderkey AS protein, 'PF' || l_partkey AS profile, l_quantity AS score, count(*) AS n FROM lineitem WHERE l_quantity >= 0.4::DOUBLE * 50 GROUP BY ALL")
def domain_hit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits whose match covers enough of the profile; a line's quantity is its length."""
    line = table(spark, sf_dir, "lineitem")
    fields = [F.concat(F.lit("p"), "l_orderkey"), "-", "100", "q", F.concat(F.lit("PF"), "l_partkey"), "50", "1e-9", "9", "0", "1", "1", "1e-9", "1e-9", F.col("l_quantity"), "0", "1", F.col("l_quantity"), "1", "9"]
    rows = line.select(F.concat_ws(" ", *(F.lit(x) if isinstance(x, str) else x for x in fields)).alias("value"))
    return profiles.read_domain_hits(spark, _lines(spark, rows, "domains")).groupBy("protein", "profile", "score").agg(F.count("*").alias("n"))


@PLANS.add("WITH p AS (SELECT DISTINCT 'c' || o_custkey AS src, 'c' || o_orderkey % 97 AS dst FROM orders WHERE o_totalprice >= 150000 AND o_custkey <> o_orderkey % 97) SELECT src, dst FROM p UNION SELECT dst, src FROM p")
def pair_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an outside program at or above a value, both ways, once."""
    o = table(spark, sf_dir, "orders").select(F.concat_ws("\t", F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("c"), F.col("o_orderkey") % 97), "o_totalprice").alias("value"))
    return tables.read_pairs(spark, _lines(spark, o, "pairs"), 150000.0)


@PLANS.add("SELECT n_regionkey::VARCHAR AS program, (s_suppkey % 3)::VARCHAR AS threshold, count(*)::BIGINT AS clusters FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL")
def grid_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid with a column a threshold, read long again."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("program"), (F.col("s_suppkey") % 3).alias("threshold")).agg(F.count("*").alias("clusters"))
    folder = scratch(spark, "grid")
    sinks.write_grid(rows, folder, ["program"], "threshold")
    read = tables.read_samples(spark, files.part_files(spark, folder), {"program": "string"}, "clusters", "long")
    return read.where("clusters is not null").select("program", F.col("sample").alias("threshold"), "clusters")


@PLANS.add("SELECT DISTINCT event_type AS stem FROM events")
def file_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by the names of their files, found in a folder."""
    paths = samples.write_bams(spark, sf_dir)
    return files.find_files(spark, paths[0].rsplit("/", 1)[0], ".bam").select(files.stem(F.col("path"), ".bam").alias("stem"))


@PLANS.add(f"""WITH {samples.READS_SQL}, o AS (SELECT * FROM (VALUES (0, 1), (1, 3), (2, 4), (3, 3), (4, 4)) t(kind, ops))
SELECT sample, name, sum(4 + 32 + 2 + 4 * ops + (bases + 1) // 2 + bases + 4)::BIGINT AS data_size FROM placed JOIN o USING (kind) WHERE ref >= 0 GROUP BY ALL""")
def bam_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each reference in each file, from the checked index."""
    _, ranges, _ = samples.reads(spark, sf_dir)
    return ranges.where("data_size > 0").select(files.stem(F.col("file"), ".bam").alias("sample"), "name", "data_size")


@PLANS.add(f"""WITH {samples.READS_SQL} SELECT sample, name, pos, mapq, flag, nm, bases::INT AS bases, md5(substring(repeat('ACGT', 20), (event_id % 4 + 1)::INT, bases)) AS digest, count(*) AS n FROM placed WHERE ref >= 0 GROUP BY ALL""")
def bam_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields, tag and letters of all placed reads."""
    _, _, reads = samples.reads(spark, sf_dir)
    return reads.groupBy("sample", "name", "pos", "mapq", "flag", "nm", F.length("seq").alias("bases"), F.md5("seq").alias("digest")).agg(F.count("*").alias("n"))


@PLANS.add(f"""WITH {samples.READS_SQL}, d AS (SELECT sample, name, i, count(*) AS depth FROM (SELECT sample, name, unnest(range(greatest(s, 50), least(e, 4950))) AS i FROM blocks WHERE ref >= 0 AND good AND alike) GROUP BY ALL),
w AS (SELECT sample, name, sum(depth)::DOUBLE AS s1, sum(depth * depth)::DOUBLE AS s2 FROM d GROUP BY ALL), every AS (SELECT DISTINCT event_type AS sample, 'k' || c || '.' || i AS name FROM events, range(8) a(c), range(1, 6) b(i))
SELECT name AS seq_id, sample, round(coalesce(s1 / 4900, 0), 6) AS mean, round(coalesce((s2 - s1 * s1 / 4900) / 4899, 0), 6) AS variance FROM every LEFT JOIN w USING (sample, name)""")
def bam_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of each sequence in each sample, from files."""
    _, ranges, reads = samples.reads(spark, sf_dir)
    found = intervals.coverage(reads, ranges.select("name", "length").distinct(), 5, 0.9, 50, samples=ranges.select(files.stem(F.col("file"), ".bam").alias("sample")).distinct())
    return found.select("seq_id", "sample", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@PLANS.add(f"""WITH {samples.READS_SQL}, u AS (SELECT sample, CASE WHEN (flag & 4) = 0 AND ref BETWEEN 0 AND 29 THEN cluster END AS cluster, event_id FROM placed WHERE ref >= 0 AND ((flag & 4) <> 0 OR good OR (flag & 256) = 0)),
b AS (SELECT event_id, sum(greatest(0, least(e, 4950) - greatest(s, 50))) AS bp FROM blocks WHERE ref >= 0 AND good AND alike GROUP BY 1)
SELECT sample, cluster, coalesce(sum(bp), 0)::BIGINT AS bases, (CASE WHEN cluster IS NULL THEN 0 ELSE 24500 END)::BIGINT AS length, count(*) AS mapped FROM u LEFT JOIN b USING (event_id) WHERE cluster IS NOT NULL GROUP BY ALL""")
def cluster_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases on, and reads at, each annotated cluster in each sample."""
    _, ranges, reads = samples.reads(spark, sf_dir)
    annotation = spark.createDataFrame([(f"k{c}", f"d__x;s__{c}") for c in range(6)], "cluster_id string, classification string")
    return ab.cluster_cells(reads, ranges.select("name", "length").distinct(), annotation, 5, 0.9, 50).where("cluster is not null")


@PLANS.add(f"""WITH {samples.READS_SQL} SELECT sample, name, pos, base, count(*) AS n FROM (SELECT sample, name, s + unnest(range(e - s)) AS pos, ('ACGT')[((event_id + r + unnest(range(e - s))) % 4 + 1)::INT] AS base FROM blocks WHERE ref >= 0 AND good AND alike) GROUP BY ALL""")
def bam_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters at each position of each sample."""
    _, _, reads = samples.reads(spark, sf_dir)
    return pileup.bases(reads, 5, 0.9).groupBy("sample", "name", "pos", "base").agg(F.count("*").alias("n"))


@PLANS.add("SELECT DISTINCT 'c' || c_custkey AS cluster, 'd__' || r_name || ';g__' || n_name || ';s__' || c_mktsegment AS classification FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal > 0")
def strict_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that must all be annotated: an unknown one fails the query."""
    wanted = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("cluster"))
    return binning.strict_join(wanted, _paths(spark, sf_dir).select("cluster", F.col("path").alias("classification")), "cluster")
