"""Set operations, strict lookups and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks import merge_reports
from .base import Plans, table

PLANS = Plans()
_FLAGS = ("A", "N", "R")


@PLANS.add("SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    a, b = line.where("l_returnflag = 'A'").select("l_suppkey"), line.where("l_quantity > 45").select("l_suppkey")
    return a.intersect(b).intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey")))


@PLANS.add("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@PLANS.add("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def report_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_reports(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@PLANS.add("SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey").exceptAll(table(spark, sf_dir, "customer").select("c_custkey"))


@PLANS.add("SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)) = 0 AND (SELECT count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer)) = 0 AS equal")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).distinct(), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    sides = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "k", "full")
    return sides.agg((F.count_if(F.col("l").isNull() | F.col("r").isNull()) == 0).alias("equal"))


@PLANS.add("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def semi_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 100000")
    return table(spark, sf_dir, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@PLANS.add("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def anti_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@PLANS.add("SELECT c_custkey, coalesce(sum(floor(o_totalprice)), 0) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
def left_lookup_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left lookup whose missing values are 0; sums go first, so the join is of keys."""
    sums = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.floor("o_totalprice").cast("double")).alias("total"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(sums, "c_custkey", "left").na.fill(0.0, ["total"])


@PLANS.add("""SELECT l_suppkey, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 2) AS "A", round(sum(l_quantity) FILTER (l_returnflag = 'N'), 2) AS "N", round(sum(l_quantity) FILTER (l_returnflag = 'R'), 2) AS "R" FROM lineitem GROUP BY 1""")
def long_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", list(_FLAGS)).agg(F.round(F.sum("l_quantity"), 2))


@PLANS.add("""WITH w AS (SELECT l_suppkey, sum(l_quantity) FILTER (l_returnflag = 'A') AS "A", sum(l_quantity) FILTER (l_returnflag = 'N') AS "N", sum(l_quantity) FILTER (l_returnflag = 'R') AS "R" FROM lineitem GROUP BY 1)
SELECT l_suppkey, 'A' AS sample, round("A", 2) AS value FROM w UNION ALL SELECT l_suppkey, 'N', round("N", 2) FROM w UNION ALL SELECT l_suppkey, 'R', round("R", 2) FROM w""")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_to_wide(spark, sf_dir).unpivot("l_suppkey", list(_FLAGS), "sample", "value")


@PLANS.add("SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC, p_name, p_partkey LIMIT 50")
def stable_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report by several keys."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").orderBy(F.desc("p_size"), "p_name", "p_partkey").limit(50)
