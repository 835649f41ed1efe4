"""Columns consolidated after a merge, with counters that the run itself gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.checks import require_columns
from ..functions.columns import fill_blank, first_nonblank, nonblank


def fill_in_run(df: DataFrame, fills: dict[str, str], drop: tuple[str, ...] = (), name: str = "fills") -> tuple[DataFrame, Observation]:
    """Blank cells of each target take the value of its source column; ``drop``: columns that go afterwards, if they are there.

    The observation counts, by target, ``<target>_before`` and ``<target>_after``: non-blank cells as the rows pass by, so they
    are known once the result has been written (``Observation.get``) and cost no scan of their own.
    """
    seen = Observation(name)
    old = {f"_old_{c}": F.col(c) for c in fills}
    filled = df.withColumns(old).withColumns({c: fill_blank(F.col(c), F.col(source)) for c, source in fills.items()})
    counts: list[Column] = []
    for c in fills:
        counts += [F.count_if(nonblank(F.col(f"_old_{c}")).isNotNull()).alias(f"{c}_before"), F.count_if(nonblank(F.col(c)).isNotNull()).alias(f"{c}_after")]
    return filled.observe(seen, *counts).drop(*old, *drop), seen


def longest_of(*columns: Column) -> Column:
    """The longest trimmed value of a row's columns, the first of equals; blank if all are."""
    texts = [F.trim(F.coalesce(c, F.lit(""))) for c in columns]
    out = texts[-1]
    for text in reversed(texts[:-1]):
        out = F.when(F.length(text) >= F.length(out), text).otherwise(out)
    return out


def joined_of(*columns: Column) -> Column:
    """The distinct (in any case) non-blank trimmed values of a row's columns as one cell: first spellings, in order."""
    values = F.array_compact(F.array(*[nonblank(c) for c in columns]))
    low = F.transform(values, F.lower)
    return F.array_join(F.filter(values, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), ";")


HOW = {"first": first_nonblank, "longest": longest_of, "joined": joined_of}


def consolidated_names(df: DataFrame, plan: dict[str, tuple[str, list[str]]], keep: list[str]) -> DataFrame:
    """``keep`` of ``df`` and of the columns that the plan makes: name -> (``first`` non-blank, ``longest`` or ``joined``, of which columns).

    A missing column is an error that names it.
    """
    require_columns(df, [c for _, columns in plan.values() for c in columns])
    made = df.withColumns({out: HOW[how](*[F.col(c) for c in columns]) for out, (how, columns) in plan.items()})
    return require_columns(made, keep).select(*keep)


def shared_value_tag(df: DataFrame, row: str, values: Column, out: str) -> DataFrame:
    """``out``: 1 where one of the row's values (an array) is also another row's, else 0.

    Values meet as counts, not as pairs of rows, so a value of many rows costs a row each.
    """
    each = df.select(F.col(row).alias("_row"), F.explode(F.array_distinct(values)).alias("_value")).where(nonblank(F.col("_value")).isNotNull()).distinct()
    shared = each.groupBy("_value").agg(F.count("*").alias("_n")).where("_n > 1").select("_value")
    tagged = each.join(shared, "_value", "left_semi").select("_row").distinct().withColumn("_tag", F.lit(1))
    return df.join(tagged, F.col(row) == F.col("_row"), "left").withColumn(out, F.coalesce("_tag", F.lit(0))).drop("_row", "_tag")
