"""Publication credit and concentration statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import require_columns


def credit(kind: str) -> Column:
    """``fractional``: 1 / n_authors (an error where that is not positive); ``full``: 1."""
    if kind == "full":
        return F.lit(1.0)
    if kind == "fractional":
        positive = F.col("n_authors") > 0
        return F.when(positive, F.lit(1.0) / F.col("n_authors")).otherwise(F.raise_error(F.lit("n_authors: every row needs at least one author")).cast("double"))
    raise ValueError(f"unknown kind of credit {kind!r}; there are full and fractional")


def productivity(df: DataFrame, kind: str = "fractional", author: str = "author_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Credit, rows and distinct publications of each author; one aggregation."""
    require_columns(df, [author, "publication_id", "n_authors", *by])
    return df.groupBy(*by, author).agg(F.sum(credit(kind)).alias("publication_credit"), F.count("publication_id").alias("publication_rows"), F.countDistinct("publication_id").alias("distinct_publications"))


def summary(df: DataFrame, value: str = "publication_credit", by: tuple[str, ...] = ()) -> DataFrame:
    """Number, total, top 1/5/10 % shares, Herfindahl index and Gini coefficient of each group.

    Equal values are one row with a count before anything is ranked: the ranks' windows run over
    distinct values, not over authors, so one global group does not bring all authors to a task.
    """
    key = list(by) or [F.lit(1).alias("_all")]
    counts = df.where(F.col(value).isNotNull()).groupBy(*key, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    names = list(by) or ["_all"]
    total = Window.partitionBy(*names)
    down = total.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    up = total.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumns({"n": F.sum("c").over(total), "t": F.sum(F.col("c") * F.col("v")).over(total), "above": F.coalesce(F.sum("c").over(down), F.lit(0)), "below": F.coalesce(F.sum("c").over(up), F.lit(0))})

    def top(share: float) -> Column:
        wanted = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(share)))
        taken = F.greatest(F.lit(0), F.least(F.col("c"), wanted - F.col("above")))
        return F.when(F.first("t") == 0, 0.0).otherwise(F.sum(taken * F.col("v")) / F.first("t"))

    # the sum of the ranks of a run of c equal values
    ranks = F.col("c") * F.col("below") + F.col("c") * (F.col("c") + 1) / 2
    share = F.col("v") / F.col("t")
    out = ranked.groupBy(*names).agg(
        F.first("n").alias("n_authors"),
        F.first("t").alias("total_credit"),
        top(0.01).alias("top_1pct_share"),
        top(0.05).alias("top_5pct_share"),
        top(0.10).alias("top_10pct_share"),
        F.coalesce(F.sum(F.when(F.col("t") != 0, F.col("c") * share * share)), F.lit(0.0)).alias("hhi"),
        F.when(F.min("v") < 0, F.raise_error(F.lit(f"{value}: Gini needs values of at least 0")).cast("double")).when(F.first("t") == 0, 0.0).otherwise(2 * F.sum(ranks * F.col("v")) / (F.first("n") * F.first("t")) - (F.first("n") + 1) / F.first("n")).alias("gini"),
    )
    return out.drop("_all")
