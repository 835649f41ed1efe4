"""Author identifiers: assignment, review flags, crosswalk, list, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import blank, nonblank, ordered_reasons
from .consolidate import distinct_in_order, longest_greatest
from .names import numbered


def assign_ids(rows: DataFrame, key: str, components: DataFrame) -> DataFrame:
    """``author_id`` and ``author_group_method`` of each row: keys of one component share the id of its least key.

    ``components(node, component)`` of the fuzzy links; a key without links is its own exact group.
    """
    keys = rows.select(key).where(~blank(F.col(key))).distinct()
    roots = keys.join(components.withColumnRenamed("node", key), key, "left").withColumn("root", F.coalesce("component", key))
    ids = numbered(roots, "root", "author_id", "AFZ%06d")
    sizes = roots.groupBy("root").agg(F.count("*").alias("_keys"))
    found = roots.join(ids, "root").join(sizes, "root").select(key, "author_id", F.when(F.col("_keys") > 1, "cautious_fuzzy").otherwise("exact").alias("author_group_method"))
    return rows.join(found, key, "left").na.fill("", ["author_id", "author_group_method"])


def distinct_per_group(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """The number of distinct values of the row's group, on every row; groups of any size are only aggregated."""
    keys = [f"_g{i}" for i in range(len(group))]
    counts = df.groupBy(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)]).agg(F.countDistinct(value).alias(out))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(group, keys, strict=True)])
    return df.join(counts, same, "left").select(*df.columns, out)


def rows_per_group(df: DataFrame, group: str, out: str, weight: str | None = None) -> DataFrame:
    """The number of rows of the row's group, on every row; a row counts ``weight`` times."""
    counts = df.groupBy(F.col(group).alias("_g")).agg((F.sum(weight) if weight else F.count("*")).alias(out))
    return df.join(counts, F.col(group).eqNullSafe(F.col("_g")), "left").select(*df.columns, out)


def distinct_names(rows: DataFrame, columns: list[str], count: str) -> DataFrame:
    """The distinct values of the name columns with their number of rows."""
    return rows.groupBy(*columns).agg(F.count("*").alias(count))


def with_names(rows: DataFrame, names: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with what ``names`` has for its name columns, null-safe; ``names`` is best a written table, which a small one is sent as."""
    other = names.select(*[F.col(c).alias(f"_n{i}") for i, c in enumerate(columns)], *[c for c in names.columns if c not in columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_n{i}")) for i, c in enumerate(columns)])
    return rows.join(other, same).drop(*[f"_n{i}" for i in range(len(columns))])


def review_flags(rows: DataFrame, common: int = 50, weight: str | None = None) -> DataFrame:
    """``manual_review_reasons`` (ordered) and ``manual_review_flag`` of ``rows(author_id, first, last, key, author_group_method)``.

    ``weight``: a column of how many rows a row stands for, so that distinct names are enough, see :func:`distinct_names`.
    """
    out = distinct_per_group(rows, ["author_id"], "key", "_keys")
    out = distinct_per_group(out.withColumn("_initial", F.substring("first", 1, 1)), ["last", "_initial"], "author_id", "_ids")
    out = rows_per_group(out, "last", "_rows", weight)
    reasons = {
        "blank_first_name": F.col("first") == "",
        "blank_last_name": F.col("last") == "",
        "single_letter_first_name": F.length("first") == 1,
        "cautious_fuzzy_group": F.col("author_group_method") == "cautious_fuzzy",
        "multiple_name_keys_in_author_id": F.col("_keys") > 1,
        "same_last_name_and_first_initial_multiple_author_ids": (F.col("first") != "") & (F.col("_ids") > 1),
        "common_last_name": F.col("_rows") >= common,
    }
    out = out.withColumn("manual_review_reasons", ordered_reasons(reasons))
    return out.withColumn("manual_review_flag", (F.col("manual_review_reasons") != "").cast("int")).drop("_keys", "_initial", "_ids", "_rows")


def longest_first(value: str, order: str) -> Column:
    """The longest trimmed value, the first of equals by ``order``; blank if there is none."""
    text = F.trim(F.coalesce(value, F.lit("")))
    return F.max_by(text, F.struct(F.length(text), -F.col(order)))


def crosswalk(rows: DataFrame, order: str) -> DataFrame:
    """One row for each author id with eleven measures; ``rows`` in the order of ``order`` (a number, unique).

    Rows that only differ in paper and place are one with the first place before the cells of an id are listed, so an id
    of any number of rows lists its distinct cells only.
    """
    known = rows.where("author_id <> ''")
    cells = ["author_last_clean", "author_first_clean", "author_last_key", "author_first_key", "author_name_key", "author_full_clean", "author_group_method", "manual_review_flag", "manual_review_reasons"]
    kinds = known.groupBy("author_id", *cells).agg(F.min(order).alias(order), F.count("*").alias("_rows"))
    papers = known.select("author_id", nonblank(F.col("doi_full")).alias("_doi")).groupBy("author_id").agg(F.countDistinct("_doi").alias("n_papers"))
    found = kinds.groupBy("author_id").agg(
        longest_first("author_last_clean", order).alias("author_last_clean"),
        longest_first("author_first_clean", order).alias("author_first_clean"),
        F.coalesce(F.min_by(nonblank(F.col("author_last_key")), F.when(~blank(F.col("author_last_key")), F.col(order))), F.lit("")).alias("author_last_key"),
        distinct_in_order("author_first_key", order).alias("author_first_keys"),
        distinct_in_order("author_name_key", order).alias("author_name_keys"),
        distinct_in_order("author_full_clean", order).alias("all_name_versions"),
        F.sum("_rows").alias("n_author_rows"),
        distinct_in_order("author_group_method", order).alias("author_group_method"),
        F.max("manual_review_flag").alias("manual_review_flag"),
        distinct_in_order("manual_review_reasons", order).alias("manual_review_reasons"),
    )
    return found.join(papers, "author_id").select("author_id", *[c for c in found.columns[1:7]], "n_author_rows", "n_papers", *found.columns[8:])


def author_list(rows: DataFrame) -> DataFrame:
    """Each author id's longest (last, first) name; ties to the smaller last, then first name."""
    cells = [F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("author_id", "final_last_name", "final_first_name")]
    named = rows.select(*cells).where("author_id <> ''")
    size = F.length("final_last_name") + F.length("final_first_name")
    best = F.min(F.struct((-size).alias("n"), "final_last_name", "final_first_name"))
    return named.groupBy("author_id").agg(best.alias("b")).select("author_id", "b.final_last_name", "b.final_first_name")


def review_extract(rows: DataFrame, columns: list[str], order: list[str], flagged: int | None = None, range_rows: int = 500_000) -> DataFrame:
    """The columns of the flagged rows, sorted; with their number known, in ranges of about ``range_rows``, however many there are."""
    out = rows.where("manual_review_flag = 1").select(*columns)
    if flagged is None:
        return out.orderBy(*order)
    return out.repartitionByRange(max(1, -(-flagged // range_rows)), *order).sortWithinPartitions(*order)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, nonblank, distinct_nonblank`` for each column: one aggregation, then one row a column."""
    aggs = []
    for c in columns:
        aggs += [F.count_if(~blank(F.col(c))).alias(f"{c}:n"), F.countDistinct(nonblank(F.col(c))).alias(f"{c}:d")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}:n`").alias("nonblank"), F.col(f"`{c}:d`").alias("distinct_nonblank")) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """How many distinct pairs there are, and how many of them have a value."""
    pairs = df.select(F.coalesce(a, F.lit("")).alias("a"), F.coalesce(b, F.lit("")).alias("b")).distinct()
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(~(blank(F.col("a")) & blank(F.col("b")))).alias("nonblank_pairs"))


def fill_counts(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """``column, before, after, filled``: non-blank values before and after a clean-up."""
    a = value_counts(before, columns).select("column", F.col("nonblank").alias("before"))
    b = value_counts(after, columns).select("column", F.col("nonblank").alias("after"))
    return a.join(b, "column").withColumn("filled", F.col("after") - F.col("before"))


def gap_numbers(rows: DataFrame, author: str, year: str, paper: str) -> DataFrame:
    """Consecutive publications with their places: previous and next number, years since entry, and whether the year is shared."""
    own = Window.partitionBy(author).orderBy(year, paper)
    out = rows.withColumns({"publication_number": F.row_number().over(own), "previous_year": F.lag(year).over(own), "previous_paper": F.lag(paper).over(own), "entry_year": F.min(year).over(Window.partitionBy(author)), "n_publications": F.count("*").over(Window.partitionBy(author))})
    out = out.where("publication_number >= 2")
    step = F.col(year) - F.col("previous_year")
    label = F.concat((F.col("publication_number") - 1).cast("string"), F.lit("->"), F.col("publication_number").cast("string"))
    return out.select(author, "entry_year", "n_publications", (F.col("publication_number") - 1).alias("from_number"), F.col("publication_number").alias("to_number"), label.alias("transition"), "previous_paper", F.col(paper).alias("paper"), "previous_year", F.col(year).alias("year"), step.alias("gap_years"), (step == 0).cast("int").alias("share_same_year"), (F.col(year) - F.col("entry_year")).alias("years_since_entry"))
