"""Column plumbing: projections, blank-aware coalescing, reshaping of delimited cells.

Missing values are blank strings in the sources; every function takes null and blank alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import require_columns


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""


def nonblank(c: Column) -> Column:
    """The trimmed value, or null where it is blank."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def keep_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Strict projection."""
    return require_columns(df, columns).select(*columns)


def pad_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Projection in which missing columns are blank."""
    return df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Tolerant drop."""
    return df.drop(*[c for c in columns if c in df.columns])


def add_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Prefix every column that does not have the prefix yet."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if not c.startswith(prefix)})


def order_columns(df: DataFrame, first: list[str]) -> DataFrame:
    """The preferred columns that exist, then the others as they were."""
    lead = [c for c in first if c in df.columns]
    return df.select(*lead, *[c for c in df.columns if c not in lead])


def first_nonblank(*columns: Column) -> Column:
    """The first non-blank value, trimmed; blank if there is none."""
    return F.coalesce(*[nonblank(c) for c in columns], F.lit(""))


def first_nonblank_source(columns: dict[str, Column]) -> Column:
    """The name of the column that :func:`first_nonblank` takes; blank if none."""
    return F.coalesce(*[F.when(~blank(c), F.lit(name)) for name, c in columns.items()], F.lit(""))


def fill_blank(target: Column, source: Column) -> Column:
    """``target``, or a non-blank ``source`` where it is blank."""
    return F.when(blank(target) & ~blank(source), source).otherwise(target)


def prefer(target: Column, source: Column) -> Column:
    """A non-blank ``source`` replaces ``target``."""
    return F.when(~blank(source), source).otherwise(target)


def observed_or_predicted(observed: Column, predicted: Column) -> Column:
    """The observed label, else the predicted one."""
    return F.coalesce(nonblank(observed), F.trim(predicted))


def combine_text(*columns: Column) -> Column:
    """Non-blank values joined by one space."""
    return F.concat_ws(" ", *[nonblank(c) for c in columns])


def map_values(c: Column, mapping: dict[str, str]) -> Column:
    """Look values up; others stay."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(table[c], c)


def split_cell(c: Column, by: str = ";", distinct: bool = False) -> Column:
    """Delimited cell to an array of trimmed non-blank values."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), by), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(parts) if distinct else parts


def join_distinct(arrays: list[Column], by: str = "; ") -> Column:
    """Distinct non-blank values of several columns or arrays in order, as one delimited cell."""
    flat = reduce(lambda a, b: F.concat(a, b), arrays)
    return F.array_join(F.array_distinct(F.filter(flat, lambda x: x.isNotNull() & (F.trim(x) != ""))), by)


def versions(df: DataFrame, array: str, prefix: str, n: int) -> DataFrame:
    """Array to ``prefix1 .. prefixn`` columns; absent versions are blank."""
    return df.withColumns({f"{prefix}{i + 1}": F.coalesce(F.get(F.col(array), i), F.lit("")) for i in range(n)})


def explode_cell(df: DataFrame, cell: str, out: str, by: str = ";") -> DataFrame:
    """One row for each value of a delimited cell, with its position from 1."""
    kept = [c for c in df.columns if c not in (out, "position")]
    parts = df.select(*kept, F.posexplode(split_cell(F.col(cell), by)).alias("position", out))
    return parts.withColumn("position", F.col("position") + 1)


def explode_parallel(df: DataFrame, a: str, b: str, out: tuple[str, str], by: str = ";") -> DataFrame:
    """Two delimited cells side by side; the shorter one is padded with blanks."""
    zipped = F.arrays_zip(F.transform(F.split(F.coalesce(F.col(a), F.lit("")), by), lambda x: F.trim(x)).alias("a"), F.transform(F.split(F.coalesce(F.col(b), F.lit("")), by), lambda x: F.trim(x)).alias("b"))
    kept = [c for c in df.columns if c not in (a, b, *out, "position")]
    rows = df.select(*kept, F.posexplode(zipped).alias("position", "z"))
    return rows.select(*kept, (F.col("position") + 1).alias("position"), F.coalesce("z.a", F.lit("")).alias(out[0]), F.coalesce("z.b", F.lit("")).alias(out[1]))


def pivot_counts(df: DataFrame, by: str, kind: str, kinds: list[str], count: Column) -> DataFrame:
    """Fixed categories as columns, absent ones 0."""
    return df.groupBy(by).pivot(kind, kinds).agg(count).na.fill(0, kinds)


def one_hot(df: DataFrame, labels: str, names: list[str], prefix: str = "has_") -> DataFrame:
    """A 0/1 column for each label of an array column."""
    return df.withColumns({prefix + n: F.array_contains(labels, n).cast("int") for n in names})


def ordered_reasons(reasons: dict[str, Column]) -> Column:
    """The names of the conditions that hold, in order, as one delimited cell."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in reasons.items()])), "; ")


def round_columns(df: DataFrame, columns: list[str], places: int = 4) -> DataFrame:
    """The named columns rounded, the others as they are; a missing one is an error."""
    return require_columns(df, columns).withColumns({c: F.round(c, places) for c in columns})


def with_constants(df: DataFrame, **values: object) -> DataFrame:
    """Constant columns that say where rows come from, such as ``record_status`` or ``match_strategy``."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def common_values(a: Column, b: Column) -> Column:
    """The distinct values that two arrays share, sorted; null arrays are empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_intersect(F.coalesce(a.cast("array<string>"), none), F.coalesce(b.cast("array<string>"), none)))


def other_values(a: Column, b: Column) -> Column:
    """The distinct values of an array that the second one lacks, sorted; null arrays are empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_except(F.coalesce(a.cast("array<string>"), none), F.coalesce(b.cast("array<string>"), none)))


def spread(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to so many partitions, which Spark leaves apart; 0: as Spark deals them."""
    return df.repartition(parts, *keys) if parts else df
