"""Association statistics and plot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assoc, graph
from .base import Plans, scratch, table
from .taxa import _ERF

PLANS = Plans()

# a part is a variant, a supplier's nation the sample, its mean discount the frequency
_CALLS = "calls AS (SELECT l_partkey AS v, s_nationkey AS sample, avg(l_discount) AS f, sum(l_quantity) AS y FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("l_partkey").alias("v"), F.col("s_nationkey").alias("sample")).agg(F.avg("l_discount").alias("f"), F.sum("l_quantity").alias("y"))


@PLANS.add(f"""WITH {_CALLS}, p AS (SELECT a.sample::VARCHAR AS i, b.sample::VARCHAR AS j, sum((a.f - b.f) * (a.f - b.f)) AS s, count(*) AS n FROM calls a JOIN calls b USING (v) GROUP BY ALL)
SELECT i, j, round(CASE WHEN s = 0 THEN 1 ELSE sqrt(s / (n + 10 * pow(2::DOUBLE, -23))) END, 7) AS distance FROM p""")
def sample_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assoc.sample_distance(_calls(spark, sf_dir), ["v"]).withColumn("distance", F.round("distance", 7))


@PLANS.add("""WITH s AS (SELECT l_partkey, regr_count(l_extendedprice, l_discount) AS n, regr_sxx(l_extendedprice, l_discount) AS sxx, regr_sxy(l_extendedprice, l_discount) AS sxy, regr_syy(l_extendedprice, l_discount) AS syy FROM lineitem GROUP BY 1)
SELECT l_partkey, n::BIGINT AS n, round(CASE WHEN sxx > 1e-9 AND n > 2 THEN sxy / sxx END, 3) AS beta, round(CASE WHEN sxx > 1e-9 AND n > 2 THEN sqrt(greatest(0, syy - sxy * sxy / sxx) / (n - 2) / sxx) END, 3) AS se FROM s""")
def glm_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_discount").alias("x"), F.col("l_extendedprice").alias("y"))
    fitted = assoc.gaussian_by_sums(line, ["l_partkey"], "x", "y", 1e-9)
    return fitted.select("l_partkey", "n", F.round("beta", 3).alias("beta"), F.round("se", 3).alias("se"))


@PLANS.add(f"""WITH {_CALLS}, r AS (SELECT v, f AS x, y AS z, (sample * 7 % 11)::DOUBLE AS y FROM calls), c AS (SELECT v, x - avg(x) OVER w AS x, z - avg(z) OVER w AS z, y - avg(y) OVER w AS y, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY v)),
s AS (SELECT v, max(n) AS n, sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy, sum(y * y) AS yy FROM c GROUP BY 1 HAVING max(n) >= 0.4::DOUBLE * 25),
b AS (SELECT v, n, xx * zz - xz * xz AS d, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz, xy, zy, yy, zz FROM s),
t AS (SELECT v, bx AS beta, sqrt((yy - bx * xy - bz * zy) / (n - 3) * zz / d) AS se FROM b), p AS (SELECT *, abs(beta / se) / sqrt(2::DOUBLE) AS q FROM t)
SELECT v AS pos, round(beta, 5) AS beta, round(se, 5) AS se, round(CASE WHEN q > 6 THEN 0 ELSE 1 - {_ERF.format('q')} END, 6) AS p FROM p""")
def glm_two_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Gaussian fit of a nation's value on frequency and abundance, by variant."""
    phenotype = {n: float(n * 7 % 11) for n in range(25)}
    calls = _calls(spark, sf_dir).select(F.lit("t").alias("classification"), F.lit("c").alias("chrom"), F.col("v").alias("pos"), F.lit(0).alias("allele"), "sample", "f", F.col("y").alias("abundance"))
    found = assoc.glm(calls, phenotype, {}, 0.4)
    return found.select("pos", F.round("beta", 5).alias("beta"), F.round("se", 5).alias("se"), F.round("p", 6).alias("p"))


@PLANS.add()
def glm_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic fits by variant; a nation's phenotype is whether its region is even."""
    nations = table(spark, sf_dir, "nation").collect()  # 25 samples
    phenotype = {r["n_nationkey"]: float(r["n_regionkey"] % 2 == 0) for r in nations}
    covariates = {r["n_nationkey"]: [float(len(r["n_name"]))] for r in nations}
    calls = _calls(spark, sf_dir).select(F.lit("t").alias("classification"), F.lit("c").alias("chrom"), F.col("v").alias("pos"), F.lit(0).alias("allele"), "sample", "f", F.col("y").alias("abundance"))
    return assoc.glm(calls, phenotype, covariates, 0.3)


@PLANS.add()
def association_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances, their components as covariates, a Gaussian fit by variant, significance."""
    import numpy as np

    folder = scratch(spark, "scan")
    calls = graph._written(_calls(spark, sf_dir), folder, "calls")  # for the distances and the fits
    distance = assoc.sample_distance(calls, ["v"]).toPandas()  # 25 x 25 samples
    nations = sorted(r["n_nationkey"] for r in table(spark, sf_dir, "nation").collect())
    parts = assoc.scaled(assoc.principal_components(distance, [str(n) for n in nations], 3))
    phenotype = {n: float(np.sin(n)) for n in nations}
    covariates = {n: parts[i].tolist() for i, n in enumerate(nations)}
    rows = calls.select(F.lit("t").alias("classification"), F.lit("c").alias("chrom"), F.col("v").alias("pos"), F.lit(0).alias("allele"), "sample", "f", F.col("y").alias("abundance"))
    return assoc.significance(assoc.glm(rows, phenotype, covariates, 0.4), folder=folder)


# a part is a test: brand the taxon, size the sequence
_TESTS = "tests AS (SELECT p_brand AS classification, 'c' || p_size AS chrom, p_partkey AS pos, ((p_partkey * 7919) % 10007 + 1) / 20000 AS p FROM part)"


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("classification"), F.concat(F.lit("c"), F.col("p_size").cast("string")).alias("chrom"), F.col("p_partkey").alias("pos"), (((F.col("p_partkey") * 7919) % 10007 + 1) / 20000).alias("p"))


@PLANS.add(f"WITH {_TESTS} SELECT round(p, 9) AS p, round(-log10(p), 6) AS observed, round(-log10((row_number() OVER (ORDER BY p) - 0.5::DOUBLE) / count(*) OVER ()), 6) AS expected FROM tests")
def qq_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assoc.qq_points(_tests(spark, sf_dir)).select(F.round("p", 9).alias("p"), F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"))


@PLANS.add(f"""WITH {_TESTS}, l AS (SELECT classification, chrom, max(pos) AS last FROM tests GROUP BY ALL), o AS (SELECT classification, chrom, coalesce(sum(last) OVER (ORDER BY classification, chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM l)
SELECT classification, chrom, pos, (o + pos)::BIGINT AS x, round(-log10(p), 6) AS y FROM tests JOIN o USING (classification, chrom)""")
def manhattan_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assoc.manhattan(_tests(spark, sf_dir)).select("classification", "chrom", "pos", "x", F.round("y", 6).alias("y"))


@PLANS.add(f"WITH {_TESTS} SELECT t.chrom, t.pos, t.classification, p.p_type AS annotation FROM tests t LEFT JOIN part p ON p.p_partkey = t.pos AND p.p_retailprice > 1200")
def variant_annotation_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "part").where("p_retailprice > 1200").select(F.concat(F.lit("c"), F.col("p_size").cast("string")).alias("chrom"), F.col("p_partkey").alias("pos"), F.col("p_type").alias("annotation"))
    return assoc.annotate(_tests(spark, sf_dir), notes).select("chrom", "pos", "classification", "annotation")


@PLANS.add(f"WITH {_TESTS} SELECT chrom, pos, CASE WHEN p > 0.05::DOUBLE / (SELECT count(*) FROM tests) THEN '-' ELSE '+' END AS significance FROM tests")
def significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assoc.significance(_tests(spark, sf_dir)).select("chrom", "pos", "significance")


@PLANS.add(f"WITH {_TESTS} SELECT chrom, pos, 'A' AS allele, round(p, 9) AS p FROM tests WHERE p <= 0.05::DOUBLE")
def replication_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites that were significant before, with the allele of then."""
    prior = assoc.significance(_tests(spark, sf_dir).withColumn("allele", F.lit("A")), 0.05, replication=True)
    return assoc.prior_alleles(_tests(spark, sf_dir), prior).select("chrom", "pos", "allele", F.round("p", 9).alias("p"))


@PLANS.add("""WITH c AS (SELECT o_custkey, bool_and(o_totalprice > 20000) AS ok FROM orders GROUP BY 1)
SELECT c_custkey AS sample, c_acctbal AS phenotype FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM c WHERE ok)""")
def phenotype_complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    phenotype = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("phenotype"))
    covariates = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample"), F.when(F.col("o_totalprice") > 20000, F.col("o_totalprice")).alias("value"))
    return assoc.complete_cases(phenotype, covariates)


@PLANS.add("""SELECT l_partkey AS pos, s_nationkey AS sample, avg(l_discount) AS abundance FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag <> 'N' GROUP BY ALL HAVING avg(l_discount) > 0""".replace("avg(l_discount) AS abundance", "round(avg(l_discount), 9) AS abundance"))
def usable_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose taxon is there and whose genotype is known."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).where("l_returnflag <> 'N'")
    g = rows.groupBy(F.col("l_partkey").cast("string").alias("classification"), F.col("s_nationkey").alias("sample")).agg(F.avg("l_discount").alias("value"), F.max("l_partkey").alias("pos"), F.array(F.lit(1.0)).alias("acgt"))
    return assoc.usable(g.select("classification", "sample", "pos", "acgt"), g.select("classification", "sample", "value")).select("pos", "sample", F.round("abundance", 9).alias("abundance"))
