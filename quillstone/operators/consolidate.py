"""Deduplication and consolidation of rows that share a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def longest(value: str, order: str) -> Column:
    """The longest value of a group; of equally long ones the first in ``order``."""
    return F.max_by(value, F.struct(F.length(F.coalesce(value, F.lit(""))), -F.col(order)))


def longest_greatest(value: str) -> Column:
    """The longest trimmed value of a group; of equally long ones the greatest; blank if there is none."""
    text = F.trim(F.coalesce(value, F.lit("")))
    return F.max(F.struct(F.length(text).alias("n"), text.alias("v")))["v"]


def first_nonblank(value: str, order: str) -> Column:
    """The first non-blank value of a group in ``order``."""
    return F.min_by(F.col(value), F.when(F.coalesce(F.trim(value), F.lit("")) != "", F.col(order)))


def distinct_in_order(value: str, order: str, by: str = "; ") -> Column:
    """Distinct non-blank values of a group in the order of their first occurrence, as one cell."""
    listed = F.array_sort(F.collect_list(F.when(F.coalesce(F.trim(value), F.lit("")) != "", F.struct(F.col(order).alias("o"), F.trim(value).alias("v")))))
    return F.array_join(F.array_distinct(F.transform(listed, lambda x: x["v"])), by)


def consolidate(df: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """One row for each key, each column its longest value, with the number of rows."""
    return df.groupBy(key).agg(*[longest(c, order).alias(c) for c in columns], F.count("*").alias("rows"))


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def share_longest(df: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """The longest value of its key's rows on every row."""
    best = df.groupBy(key).agg(longest(column, order).alias("_best"))
    return df.drop(column).join(best, key).withColumnRenamed("_best", column)


def drop_blank_author_copies(df: DataFrame, title: str, authors: str) -> DataFrame:
    """Rows without authors go where their title occurs again."""
    n = F.count("*").over(Window.partitionBy(title))
    return df.withColumn("_n", n).where(~((F.col("_n") > 1) & (F.coalesce(F.trim(authors), F.lit("")) == ""))).drop("_n")


def duplicate_stats(df: DataFrame, key: str) -> DataFrame:
    """Groups and rows of keys that occur more than once, and the distribution's extremes."""
    sizes = df.where(F.coalesce(F.trim(key), F.lit("")) != "").groupBy(key).count()
    many = F.col("count") > 1
    return sizes.agg(F.count_if(many).alias("duplicate_groups"), F.coalesce(F.sum(F.when(many, F.col("count"))), F.lit(0)).alias("duplicate_rows"), F.max("count").alias("largest_group"), F.count("*").alias("distinct_keys"))
