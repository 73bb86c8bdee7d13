"""Profile databases and the hit tables of a profile search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import read_lines


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(profile, length, sequence_score, domain_score): thresholds are the gathering
    cut-offs of PF profiles and the trusted ones of TIGR profiles."""
    text = spark.read.option("lineSep", "//\n").text(path)
    number = r"\s+([-0-9.]+)\s+([-0-9.]+)"
    accession = F.regexp_extract("value", r"(?m)^ACC\s+(\S+)", 1)
    cut = lambda i: F.when(accession.startswith("PF"), F.regexp_extract("value", r"(?m)^GA" + number, i)).when(accession.startswith("TIGR"), F.regexp_extract("value", r"(?m)^TC" + number, i))
    score = lambda i: F.when(cut(i) != "", cut(i)).cast("double")
    length = F.regexp_extract("value", r"(?m)^LENG\s+(\d+)", 1)
    return text.select(accession.alias("profile"), F.when(length != "", length).cast("int").alias("length"), score(1).alias("sequence_score"), score(2).alias("domain_score")).where("profile <> ''")


def read_hits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(ordinal, protein, profile, score) of a per-sequence hit table; the profile is
    the accession, or the query's name where there is none."""
    lines = read_lines(spark, path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = lines.select("file", "line_no", F.split(F.trim("value"), r"\s+").alias("f"))
    return f.select(F.struct("file", "line_no").alias("ordinal"), F.col("f")[0].alias("protein"), F.when(F.col("f")[3] == "-", F.col("f")[2]).otherwise(F.col("f")[3]).alias("profile"), F.col("f")[5].cast("double").alias("score"))


def read_domain_hits(spark: SparkSession, path: str | list[str], coverage: float = 0.4) -> DataFrame:
    """(ordinal, protein, profile, score) of a per-domain hit table whose match covers
    at least `coverage` of the profile."""
    lines = read_lines(spark, path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = lines.select("file", "line_no", F.split(F.trim("value"), r"\s+").alias("f"))
    df = f.select(F.struct("file", "line_no").alias("ordinal"), F.col("f")[0].alias("protein"), F.when(F.col("f")[4] == "-", F.col("f")[3]).otherwise(F.col("f")[4]).alias("profile"), F.col("f")[5].cast("double").alias("profile_length"), F.col("f")[13].cast("double").alias("score"), F.col("f")[15].cast("double").alias("start"), F.col("f")[16].cast("double").alias("end"))
    return df.where((F.col("end") - F.col("start") + 1) / F.col("profile_length") >= coverage).select("ordinal", "protein", "profile", "score")
