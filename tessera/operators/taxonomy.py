"""Taxonomy paths: prefixes, roll-up and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefixes(path: Column, separator: str = ";") -> Column:
    """Every prefix of a path, from the top to the path itself."""
    parts = F.split(path, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))


def nodes(annotation: DataFrame, path: str = "classification") -> DataFrame:
    """(node): all prefixes, once."""
    return annotation.select(F.explode(prefixes(F.col(path))).alias("node")).distinct()


def roll_up(values: DataFrame, path: str, value: str, by: list[str]) -> DataFrame:
    """(by, node, value): each row's value added to every prefix of its path. Values of
    equal paths are added before paths are opened, so rows follow the taxonomy."""
    summed = values.groupBy(*by, path).agg(F.sum(value).alias(value))
    return summed.select(*by, value, F.explode(prefixes(F.col(path))).alias("node")).groupBy(*by, "node").agg(F.sum(value).alias(value))


def rank(node: Column) -> Column:
    """The first letter of the last component."""
    return F.substring(F.element_at(F.split(node, ";"), -1), 1, 1)


def of_ranks(df: DataFrame, ranks: list[str], node: str = "node") -> DataFrame:
    return df.where(rank(F.col(node)).isin(*ranks))
