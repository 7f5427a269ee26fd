"""Aggregates that questions about tables ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filtered_sum(rows: DataFrame, where: str | Column, column: str, digits: int = 2) -> DataFrame:
    """One row: how many rows hold, and the sum of a column over them."""
    return rows.filter(where).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(column), digits).alias("total"))


def largest_per_group(rows: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """(group, key, value) of the row with the largest value in each group, of equal ones
    that with the least key (a number): one aggregation without a sort."""
    best = F.max(F.struct(F.col(value), (-F.col(key)).alias("k"))).alias("best")
    found = rows.groupBy(group).agg(best)
    return found.select(group, (-F.col("best.k")).alias(key), F.col(f"best.{value}").alias(value))


def share_of_total(rows: DataFrame, group: str, digits: int = 6) -> DataFrame:
    """(group, n, pct): rows of each group, and their share of all in percent."""
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy())  # over the few groups
    return counts.select(group, "n", F.round(F.lit(100.0) * F.col("n") / whole, digits).alias("pct"))


def difference_of_means(left: DataFrame, right: DataFrame, key: str, left_value: str, right_value: str, digits: int = 6) -> DataFrame:
    """(key, difference): mean of one table's column less that of another's, for keys
    that both have.  Both are averaged before they meet."""
    a = left.groupBy(key).agg(F.avg(left_value).alias("a"))
    b = right.groupBy(key).agg(F.avg(right_value).alias("b"))
    return a.join(b, key).select(key, F.round(F.col("a") - F.col("b"), digits).alias("difference"))


def count_per_key(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of each key."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def first_per_digest(rows: DataFrame, group: list[str], content: str, key: str) -> DataFrame:
    """(group, digest, key) of the row with the least key of each content in a group;
    the contents themselves are not shuffled."""
    digests = rows.groupBy(*group, F.sha1(F.col(content).cast("binary")).alias("digest"))
    return digests.agg(F.min(key).alias(key))
