"""Row filters of the cleaning steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import blank, split_cell


def has_any(cell: Column, values: list[str], by: str = ";") -> Column:
    """Does a delimited cell hold one of the values?"""
    return F.arrays_overlap(split_cell(cell, by), F.array(*[F.lit(v) for v in values]))


def mentions(phrase: str, *columns: Column) -> Column:
    """Does one of the columns hold the phrase, in any case?"""
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(phrase.lower()))
    return out


def drop_unlinked_without_key(df: DataFrame, status: str, only: str, key: str) -> DataFrame:
    """Without rows of one source only whose key is blank."""
    return df.where(~((F.col(status) == only) & blank(F.col(key))))


def drop_codes(df: DataFrame, code: str, letters: list[str]) -> DataFrame:
    """Without rows whose code begins with one of the letters."""
    return df.where(~F.upper(F.substring(F.trim(F.coalesce(code, F.lit(""))), 1, 1)).isin(*letters))


def numbered_since(df: DataFrame, paper: str, date: str, year: int, pattern: str = r"^w\d+$") -> DataFrame:
    """Rows whose number fits the pattern whole and whose date (text) is in that year or later; unreadable dates go."""
    return df.where(F.rlike(F.coalesce(paper, F.lit("")), F.lit(pattern)) & (F.year(F.try_to_timestamp(F.col(date))) >= year))


def listed(columns: dict[str, list[object]]) -> Column:
    """Is a row on one of the blocklists (column to values; texts compare trimmed, in any case)?"""
    out = F.lit(False)
    for c, values in columns.items():
        own = F.lower(F.trim(F.col(c).cast("string")))
        out = out | F.coalesce(own.isin(*[str(v).strip().lower() for v in values]), F.lit(False))
    return out


def patch(df: DataFrame, column: str, changes: list[tuple[Column, str]]) -> DataFrame:
    """Single rows set by hand: (condition, new value); the last condition that holds wins."""
    out = F.col(column)
    for condition, value in changes:
        out = F.when(condition, F.lit(value)).otherwise(out)
    return df.withColumn(column, out)


def domain_order(c: Column, values: list[str]) -> Column:
    """Place of a value in a fixed order, others after it."""
    place = F.array_position(F.array(*[F.lit(v) for v in values]), c)
    return F.when(place > 0, place).otherwise(len(values) + 1).cast("int")


def outer_order(left_id: str, right_id: str) -> list[Column]:
    """Order of a full outer join's rows: left id, then right id, missing ones last."""
    return [F.asc_nulls_last(left_id), F.asc_nulls_last(right_id)]


def kept_in_order(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each non-blank key by ``order``; rows with a blank key all stay, and nothing else moves."""
    first = df.where(~blank(F.col(key))).groupBy(key).agg(F.min(order).alias(order))
    return df.where(blank(F.col(key))).unionByName(df.join(first, [key, order], "left_semi"))
