"""Taxonomy, abundance and group tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import abundance, taxonomy
from .base import Plans, table

PLANS = Plans()
_PATHS = """paths AS (SELECT 'd__' || r_name || ';p__' || n_name || ';c__' || c_mktsegment AS path, floor(o_totalprice) AS value, o_orderstatus AS sample FROM orders
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""
_NODES = "nodes AS (SELECT sample, value, unnest([string_split(path, ';')[1], array_to_string(string_split(path, ';')[1:2], ';'), path]) AS node FROM paths)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    where = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t("orders").join(where, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.concat(F.lit("d__"), "r_name", F.lit(";p__"), "n_name", F.lit(";c__"), "c_mktsegment").alias("path"), F.floor("o_totalprice").cast("double").alias("value"), F.col("o_orderstatus").alias("sample"))


@PLANS.add(f"WITH {_PATHS}, {_NODES} SELECT DISTINCT node FROM nodes")
def taxonomy_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.nodes(_paths(spark, sf_dir), "path")


@PLANS.add(f"WITH {_PATHS}, {_NODES} SELECT sample, node, round(sum(value), 1) AS value FROM nodes GROUP BY ALL")
def taxonomy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.roll_up(_paths(spark, sf_dir), "path", "value", ["sample"]).withColumn("value", F.round("value", 1))


@PLANS.add(f"WITH {_PATHS}, {_NODES} SELECT node, round(sum(value), 1) AS value FROM nodes WHERE node LIKE '%;p\\_\\_%' ESCAPE '\\' AND node NOT LIKE '%;c\\_\\_%' ESCAPE '\\' GROUP BY ALL")
def rank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = taxonomy.roll_up(_paths(spark, sf_dir), "path", "value", [])
    return taxonomy.of_ranks(rolled, ["p"]).withColumn("value", F.round("value", 1))


@PLANS.add("SELECT c_custkey, 'd__' || c_mktsegment || ';g__' AS genus FROM customer WHERE false UNION ALL SELECT c_custkey, 'd__A;g__' || c_mktsegment AS genus FROM customer WHERE c_custkey % 3 <> 0")
def named_genus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import with_genus

    genus = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    df = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("d__A;g__"), genus, F.lit(";s__x")).alias("classification"))
    return with_genus(df).select("c_custkey", "genus")


# a sample is a tenth of the customers, a cluster a nation; customers of nation 7 are on none
_CELLS = """cells AS (SELECT (o_custkey % 10)::INT AS sample, CASE WHEN c_nationkey <> 7 THEN c_nationkey END AS cluster, sum(round(o_totalprice)) AS bases, max(100000 + 1000 * c_nationkey) AS length, count(*) AS mapped
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""


def _abundance_sql(gate: str) -> str:
    return f"""WITH {_CELLS}, d AS (SELECT *, CASE WHEN cluster IS NOT NULL AND bases / (length + 10 * pow(2::DOUBLE, -23)) >= {gate} THEN bases / (length + 10 * pow(2::DOUBLE, -23)) ELSE 0 END AS depth FROM cells),
t AS (SELECT sample, sum(depth) AS al, coalesce(sum(mapped) FILTER (depth > 0), 0) AS onn, sum(mapped) AS reads FROM d GROUP BY 1)
SELECT sample, cluster, round(depth * onn / ((reads + 10 * pow(2::DOUBLE, -23)) * (al + 10 * pow(2::DOUBLE, -23))), 9) AS value FROM d JOIN t USING (sample) WHERE cluster IS NOT NULL"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cluster = F.when(F.col("c_nationkey") != 7, F.col("c_nationkey"))
    return o.groupBy((F.col("o_custkey") % 10).cast("int").alias("sample"), cluster.alias("cluster")).agg(F.sum(F.round("o_totalprice")).alias("bases"), F.max(100000 + 1000 * F.col("c_nationkey")).alias("length"), F.count("*").alias("mapped"))


@PLANS.add(_abundance_sql("0.1::DOUBLE"))
def relative_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abundance.relative_depth(_cells(spark, sf_dir)).withColumn("value", F.round("value", 9))


@PLANS.add(_abundance_sql("70::DOUBLE"))
def min_depth_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abundance.relative_depth(_cells(spark, sf_dir), 70.0).withColumn("value", F.round("value", 9))


@PLANS.add("SELECT event_id, round(log10(least(1::DOUBLE, greatest(1e-5::DOUBLE, value / 100))), 9) AS value FROM events")
def log_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("value"))
    return abundance.log_abundance(e).withColumn("value", F.round("value", 9))


# balances, rounded so that some are tied, of two segments in each nation
_RANKS = """b AS (SELECT c_nationkey, c_mktsegment = 'BUILDING' AS first, round(c_acctbal / 100) AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
k AS (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY v) + (count(*) OVER (PARTITION BY c_nationkey, v) - 1) / 2 AS r, count(*) OVER (PARTITION BY c_nationkey, v) AS t FROM b),
u AS (SELECT c_nationkey, count(*) FILTER (first) AS n1, count(*) FILTER (NOT first) AS n2, coalesce(sum(r) FILTER (first), 0) - count(*) FILTER (first) * (count(*) FILTER (first) + 1) / 2 AS u1, sum(t * t - 1)::DOUBLE AS ties FROM k GROUP BY 1)"""


def _rank_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_nationkey", "c_mktsegment", F.round(F.col("c_acctbal") / 100).alias("v"))
    return stats.rank_sums(c, ["c_nationkey"], "v", F.col("c_mktsegment") == "BUILDING")


@PLANS.add(f"WITH {_RANKS} SELECT c_nationkey, n1, n2, u1, ties FROM u")
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank_sums(spark, sf_dir)


#: The error function at a positive x: the sum of x^(2n+1) e^(-x^2) / gamma(n + 3/2).
_ERF = "list_sum(list_transform(range(0, 160), lambda i: exp(-{0} * {0} + (2 * i + 1) * ln({0}) - lgamma(i + 1.5::DOUBLE))))"


def _p_sql(rows: str, keep: str) -> str:
    """Two-sided p values of `rows` (n1, n2, u1, ties): exact by counting the rank sums of all
    choices, or the normal tail by the series of the error function."""
    return f"""big AS (SELECT coalesce(max(n1 + n2), 0) AS most FROM {rows} WHERE ties = 0 AND least(n1, n2) <= 8),
ways(n, k, s, w) AS (SELECT 0, 0, 0, 1::DOUBLE UNION ALL SELECT n, k, s, sum(w) FROM (SELECT n + 1 AS n, k, s, w FROM ways WHERE n < (SELECT most FROM big) UNION ALL SELECT n + 1, k + 1, s + n + 1, w FROM ways WHERE n < (SELECT most FROM big) AND k < 8) GROUP BY ALL),
tails AS (SELECT *, greatest(u1, n1 * n2 - u1) AS u, least(n1, n2) AS small, n1 + n2 AS n FROM {rows}),
exact AS (SELECT n, k, s - k * (k + 1) / 2 AS u, sum(w) OVER (PARTITION BY n, k ORDER BY s DESC) / sum(w) OVER (PARTITION BY n, k) AS p FROM ways),
z AS (SELECT *, n1 * n2 / 12::DOUBLE * (n + 1 - ties / (n * (n - 1)::DOUBLE)) AS var FROM tails),
x AS (SELECT *, CASE WHEN var > 0 THEN (u - n1 * n2 / 2::DOUBLE - 0.5::DOUBLE) / sqrt(var) / sqrt(2::DOUBLE) END AS x FROM z),
pv AS (SELECT {keep}, CASE WHEN n1 = 0 OR n2 = 0 THEN 1 WHEN ties = 0 AND small <= 8 THEN least(1, 2 * (SELECT min(e.p) FROM exact e WHERE e.n = x.n AND e.k = x.small AND e.u = ceil(x.u)))
 WHEN x IS NULL THEN 1 ELSE least(1, CASE WHEN x > 6 THEN 0 WHEN x < 0 THEN 1 + {_ERF.format('(-x)')} WHEN x = 0 THEN 1 ELSE 1 - {_ERF.format('x')} END) END AS p FROM x)"""


@PLANS.add(f"WITH RECURSIVE {_RANKS}, {_p_sql('u', 'c_nationkey')} SELECT c_nationkey, round(p, 6) AS p FROM pv")
def mann_whitney_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank_sums(spark, sf_dir).select("c_nationkey", F.round(stats.mann_whitney("u1", "n1", "n2", "ties"), 6).alias("p"))


@PLANS.add("SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY round(c_acctbal / 100)) + (count(*) OVER (PARTITION BY c_mktsegment, round(c_acctbal / 100)) - 1) / 2 AS rank FROM customer")
def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.round(F.col("c_acctbal") / 100).alias("v"))
    return c.select("c_custkey", stats.average_rank("v", ["c_mktsegment"]).alias("rank"))


_P = "p AS (SELECT s_suppkey, s_nationkey % 5 AS grp, ((s_suppkey * 7919) % 10007 + 1) / 20000 AS p FROM supplier)"


def _p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("grp"), (((F.col("s_suppkey") * 7919) % 10007 + 1) / 20000).alias("p"))


@PLANS.add(f"""WITH {_P}, r AS (SELECT *, p * count(*) OVER (PARTITION BY grp) / row_number() OVER (PARTITION BY grp ORDER BY p) AS raw FROM p)
SELECT s_suppkey, grp, round(p, 9) AS p, round(least(1, min(raw) OVER (PARTITION BY grp ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM r""")
def fdr_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.benjamini_hochberg(_p_values(spark, sf_dir), "p", ["grp"]).select("s_suppkey", "grp", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


@PLANS.add(f"WITH {_P} SELECT s_suppkey, round(least(1, p * count(*) OVER (PARTITION BY grp)), 9) AS q FROM p")
def bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _p_values(spark, sf_dir)
    tests = df.groupBy("grp").agg(F.count("*").alias("m"))
    return df.join(tests, "grp").select("s_suppkey", F.round(stats.bonferroni(F.col("p"), F.col("m")), 9).alias("q"))


_MEDIANS = """v AS (SELECT c_nationkey AS node, c_mktsegment AS grp, round(greatest(c_acctbal, 0)) AS v FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING')),
m AS (SELECT node, median(v) FILTER (grp = 'AUTOMOBILE') AS m1, median(v) FILTER (grp = 'BUILDING') AS m2,
 count(*) FILTER (grp = 'AUTOMOBILE' AND v > 0) >= 0.9::DOUBLE * count(*) FILTER (grp = 'AUTOMOBILE') AND count(*) FILTER (grp = 'BUILDING' AND v > 0) >= 0.9::DOUBLE * count(*) FILTER (grp = 'BUILDING') AS tested FROM v GROUP BY 1)"""


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"))
    return c.select(F.col("c_nationkey").alias("node"), F.col("c_custkey").alias("sample"), F.round(F.greatest("c_acctbal", F.lit(0.0))).alias("value")), c.select(F.col("c_custkey").alias("sample"), F.col("c_mktsegment").alias("grp"))


@PLANS.add(f"WITH {_MEDIANS} SELECT node, CASE WHEN m1 <> 0 THEN m1 END AS median1, CASE WHEN m1 = 0 OR m2 = 0 THEN '?' WHEN m1 > m2 THEN '>' WHEN m1 = m2 THEN '=' ELSE '<' END AS flag, CASE WHEN m2 <> 0 THEN m2 END AS median2 FROM m")
def median_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, groups = _groups(spark, sf_dir)
    return stats.group_test(values, groups, 0.0, 0.9).select("node", "median1", "flag", "median2")


@PLANS.add(f"""WITH RECURSIVE {_MEDIANS}, t AS (SELECT node, v, count(*) AS t, count(*) FILTER (grp = 'AUTOMOBILE') AS t1 FROM v GROUP BY ALL),
rk AS (SELECT *, sum(t) OVER (PARTITION BY node ORDER BY v) - t + (t + 1) / 2 AS rank FROM t), rs AS (SELECT node, sum(t1) AS n1, sum(t - t1) AS n2, sum(t1 * rank) AS r1, sum(t * t * t - t) AS ties FROM rk GROUP BY 1),
us AS (SELECT node, n1::BIGINT AS n1, n2::BIGINT AS n2, r1 - n1 * (n1 + 1) / 2 AS u1, ties::DOUBLE AS ties FROM rs), {_p_sql('us', 'node')},
raw AS (SELECT m.*, CASE WHEN tested THEN p END AS raw FROM m JOIN pv USING (node)), st AS (SELECT *, raw * count(raw) OVER () / row_number() OVER (ORDER BY raw NULLS LAST) AS step FROM raw),
q AS (SELECT *, least(1, min(step) OVER (ORDER BY raw DESC NULLS FIRST)) AS q, m1 = 0 OR m2 = 0 AS bare FROM st)
SELECT node, 'AUTOMOBILE' AS group1, 'BUILDING' AS group2, CASE WHEN m1 <> 0 THEN m1 END AS median1, CASE WHEN bare THEN '?' WHEN m1 > m2 THEN '>' WHEN m1 = m2 THEN '=' ELSE '<' END AS flag, CASE WHEN m2 <> 0 THEN m2 END AS median2,
round(CASE WHEN bare OR raw IS NULL THEN 1 ELSE raw END, 6) AS p, round(CASE WHEN bare OR raw IS NULL THEN 1 ELSE q END, 6) AS q FROM q""")
def group_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, groups = _groups(spark, sf_dir)
    return stats.group_test(values, groups, 0.0, 0.9, "benjamini-hochberg").withColumns({"p": F.round("p", 6), "q": F.round("q", 6)})


@PLANS.add(f"WITH {_MEDIANS} SELECT node FROM m WHERE tested")
def prevalence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, groups = _groups(spark, sf_dir)
    return stats.prevalent(*stats.paired(values, groups), 0.0, 0.9).where("tested").select("node")


@PLANS.add("SELECT a.g AS group1, b.g AS group2 FROM (SELECT DISTINCT c_mktsegment AS g FROM customer) a JOIN (SELECT DISTINCT c_mktsegment AS g FROM customer) b ON a.g < b.g")
def group_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.group_pairs(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("grp")))


@PLANS.add("SELECT s_suppkey, round((s_acctbal - avg(s_acctbal) OVER w) / (coalesce(stddev_samp(s_acctbal) OVER w, 0) + 10 * pow(2::DOUBLE, -23)), 6) AS z FROM supplier WINDOW w AS (PARTITION BY s_nationkey)")
def standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").alias("z"))
    return stats.standardise(s, ["s_nationkey"], "z").select("s_suppkey", F.round("z", 6).alias("z"))


@PLANS.add("SELECT event_id, round((ln(1 + value) - min(ln(1 + value)) OVER w) / (max(ln(1 + value)) OVER w - min(ln(1 + value)) OVER w + 10 * pow(2::DOUBLE, -23)), 9) AS x FROM events WINDOW w AS (PARTITION BY event_type)")
def min_max_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.log1p("value").alias("x"))
    return stats.min_max(e, ["event_type"], "x").select("event_id", F.round("x", 9).alias("x"))


@PLANS.add("SELECT event_type, round(quantile_cont(least_value, 0.2), 9) AS p20 FROM (SELECT event_type, user_id, min(value) AS least_value FROM events GROUP BY ALL) GROUP BY 1")
def percentile_of_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.min("value").alias("v"))
    return least.groupBy("event_type").agg(F.round(F.percentile("v", 0.2), 9).alias("p20"))
