"""Rank tests, false-discovery control and scaling."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def average_rank(value: str, by: list[str]) -> Column:
    """Ranks within `by`, ties sharing the mean of theirs."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(*by, value)) - 1) / 2


def rank_sums(df: DataFrame, by: list[str], value: str, first: Column) -> DataFrame:
    """(by, n1, n2, u1, ties): the Mann-Whitney U of the rows where `first` holds, and
    the tie term sum(t^3 - t).

    Values are counted before they are ranked, so a window's rows are distinct
    values, and the mean rank of a value is what stands below it plus half its own."""
    tied = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("t"), F.count_if(first).alias("t1"))
    below = F.sum("t").over(Window.partitionBy(*by).orderBy(value)) - F.col("t")
    ranked = tied.withColumn("rank", below + (F.col("t") + 1) / 2)
    out = ranked.groupBy(*by).agg(F.sum("t1").alias("n1"), F.sum(F.col("t") - F.col("t1")).alias("n2"), F.sum(F.col("t1") * F.col("rank")).alias("r1"), F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    return out.select(*by, "n1", "n2", (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u1"), "ties")


def _exact(u: float, n1: int, n2: int) -> float:
    """P(U >= u) without ties, by the recursion on the number of arrangements."""
    ways = [1] + [0] * (n1 * n2)
    for i in range(1, n1 + 1):  # Gaussian binomial, factor by factor
        for s in range(n1 * n2, n2 + i - 1, -1):
            ways[s] -= ways[s - n2 - i]
        for s in range(i, n1 * n2 + 1):
            ways[s] += ways[s - i]
    return sum(ways[math.ceil(u) :]) / math.comb(n1 + n2, n1)


def mann_whitney_p(u1: float, n1: int, n2: int, ties: float, small: int = 8) -> float:
    """Two-sided; exact if a side has at most `small` values and none are tied, else
    normal with the tie and continuity corrections."""
    if not n1 or not n2:
        return 1.0
    u = max(u1, n1 * n2 - u1)
    if ties == 0 and min(n1, n2) <= small:
        return min(1.0, 2 * _exact(u, n1, n2))
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    return min(1.0, math.erfc((u - n1 * n2 / 2 - 0.5) / math.sqrt(var) / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def mann_whitney(u1: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([mann_whitney_p(*x) for x in zip(u1, n1, n2, ties, strict=True)])


def bonferroni(p: Column, tests: Column) -> Column:
    return F.least(F.lit(1.0), p * tests)


def benjamini_hochberg(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """Adds q, the step-up values of the rows with a p value, within `by`; equal p values
    get equal q. For tables of results, whose rows are tests."""
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(F.col(p).asc_nulls_last()))
    m = F.count(p).over(w)
    df = df.withColumn("_raw", F.when(F.col(p).isNotNull(), F.col(p) * m / rank))
    return df.withColumn("q", F.least(F.lit(1.0), F.min("_raw").over(w.orderBy(F.col(p).desc_nulls_first())))).drop("_raw")


def standardise(df: DataFrame, by: list[str], value: str, eps: float = 10 * 2.0**-23) -> DataFrame:
    """`value` less its mean, over its sample deviation plus eps, within `by`."""
    sums = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_s"))
    return df.join(sums, by).withColumn(value, (F.col(value) - F.col("_m")) / (F.col("_s") + eps)).drop("_m", "_s")


def min_max(df: DataFrame, by: list[str], value: str, eps: float = 10 * 2.0**-23) -> DataFrame:
    """`value` brought to [0, 1] within `by`."""
    sums = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return df.join(sums, by).withColumn(value, (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + eps)).drop("_lo", "_hi")


def group_test(values: DataFrame, groups: DataFrame, floor: float, prevalence: float = 0.5, method: str = "bonferroni", pair: tuple[str, str] | None = None) -> DataFrame:
    """Tests each taxon between all pairs of groups.

    values: (node, sample, value); groups: (sample, grp). A taxon is tested if in both
    groups at least `prevalence` of the samples are above `floor`; the others get
    p = q = 1. Gives node, group1, group2, median1, flag, median2, p, q; a median at
    the floor is null, its flag `?`, its p and q 1."""
    if method not in ("bonferroni", "benjamini-hochberg", "none"):
        raise ValueError(method)
    rows, first, by = paired(values, groups, pair)
    seen = prevalent(rows, first, by, floor, prevalence)
    sums = rank_sums(rows, by, "value", first)
    df = seen.join(sums, by).withColumn("raw", F.when(F.col("tested"), mann_whitney("u1", "n1", "n2", "ties")))
    scope = ["group1", "group2"]
    if method == "benjamini-hochberg":
        df = benjamini_hochberg(df, "raw", scope)
    else:
        tests = F.count("raw").over(Window.partitionBy(*scope))
        df = df.withColumn("q", bonferroni(F.col("raw"), tests) if method == "bonferroni" else F.col("raw"))
    bare1, bare2 = F.col("m1") == floor, F.col("m2") == floor
    bare = bare1 | bare2
    flag = F.when(bare, "?").when(F.col("m1") > F.col("m2"), ">").when(F.col("m1") == F.col("m2"), "=").otherwise("<")
    shown = lambda c: F.when(bare, 1.0).otherwise(F.coalesce(F.col(c), F.lit(1.0)))
    return df.select("node", *scope, F.when(~bare1, F.col("m1")).alias("median1"), flag.alias("flag"), F.when(~bare2, F.col("m2")).alias("median2"), shown("raw").alias("p"), shown("q").alias("q"))


def group_pairs(groups: DataFrame, pair: tuple[str, str] | None = None) -> DataFrame:
    """(group1, group2): all pairs of groups by name, or those within `pair`."""
    names = groups.select("grp").distinct()
    pairs = names.select(F.col("grp").alias("group1")).join(names.select(F.col("grp").alias("group2")), F.col("group1") < F.col("group2"))
    return pairs.where(F.col("group1").isin(*pair) & F.col("group2").isin(*pair)) if pair else pairs


def paired(values: DataFrame, groups: DataFrame, pair: tuple[str, str] | None = None) -> tuple[DataFrame, Column, list[str]]:
    """The values' rows under each pair that their group is in; whether it is the first; the
    columns of a test. A group goes to its pairs by name, in two joins of equality, so that
    nothing is matched with all pairs."""
    rows = values.join(groups, "sample")
    pairs = group_pairs(groups, pair)
    both = pairs.select(F.col("group1").alias("grp"), "group1", "group2").unionByName(pairs.select(F.col("group2").alias("grp"), "group1", "group2"))
    return rows.join(both, "grp"), F.col("grp") == F.col("group1"), ["group1", "group2", "node"]


def prevalent(rows: DataFrame, first: Column, by: list[str], floor: float, prevalence: float) -> DataFrame:
    """(by, m1, m2, counts, tested): medians, and whether in both groups at least
    `prevalence` of the samples are above `floor`."""
    above = F.col("value") > floor
    return rows.groupBy(*by).agg(
        F.median(F.when(first, F.col("value"))).alias("m1"), F.median(F.when(~first, F.col("value"))).alias("m2"),
        F.count_if(first & above).alias("c1"), F.count_if(~first & above).alias("c2"), F.count_if(first).alias("k1"), F.count_if(~first).alias("k2"),
    ).withColumn("tested", (F.col("c1") >= prevalence * F.col("k1")) & (F.col("c2") >= prevalence * F.col("k2")))

