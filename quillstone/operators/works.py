"""The cleaning of a source of nested work records, from raw rows to one row a title."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import require_columns
from ..functions.columns import blank, first_nonblank
from ..functions.records import json_value, scored_names
from ..functions.text import DOI_VARIANTS, announced_codes, clean_abstract, doi_key, inverted_index_text, is_not_paper, letters_and_numbers, unescape
from .filters import listed

COLUMNS = ["id", "doi", "title", "display_name", "publication_year", "authors", "author_institutions", "abstract_inverted_index", "primary_topic", "keywords", "concepts", "cited_by_count", "journal", "issn"]
#: Of a title's versions: the first one's value, the longest value, or all versions' listed values.
FIRST = ["id", "publication_year", "authors", "cited_by_count", "journal", "issn", "primary_domain", "primary_field", "primary_subfield", "primary_topic"]
LONGEST = ["author_institutions", "abstract", "codes"]
UNION = ["keywords", "top3_keywords", "concepts", "top3_concepts", "level0_concepts"]


@dataclass(frozen=True)
class WorkRules:
    """``blocked``: values by column whose rows go; ``titles``: exact titles that go; ``renamed``: (title, year, new title) of single
    rows; ``versions``: how many DOI columns there are (a title's further DOIs are in ``more_dois``)."""

    blocked: dict[str, list[object]] = field(default_factory=dict)
    titles: tuple[str, ...] = ()
    renamed: tuple[tuple[str, int, str], ...] = ()
    phrases: tuple[str, ...] | None = None
    versions: int = 3


def _rows(df: DataFrame, rules: WorkRules) -> DataFrame:
    """Filters and the columns that come from one row."""
    rows = require_columns(df, COLUMNS)
    rows = rows.where(~listed(rules.blocked)) if rules.blocked else rows
    rows = rows.withColumn("title", first_nonblank(F.col("title"), F.col("display_name"))).where("title <> ''")
    rows = rows.where(~is_not_paper(F.col("title"), list(rules.phrases) if rules.phrases is not None else None))
    rows = rows.where(~listed({"title": list(rules.titles)})) if rules.titles else rows
    title = letters_and_numbers(F.col("title"))
    for old, year, new in rules.renamed:
        title = F.when((title == old) & (F.col("publication_year").cast("int") == year), F.lit(new)).otherwise(title)
    raw = rows.withColumns({"title": title, "abstract": inverted_index_text(F.col("abstract_inverted_index"))}).where("title <> ''")
    topic = F.col("primary_topic")
    return raw.withColumns({
        "doi": doi_key(F.col("doi"), **DOI_VARIANTS["works"]),
        "codes": F.array_join(announced_codes(unescape(F.coalesce("abstract", F.lit("")))), "; "),
        "abstract": clean_abstract(F.col("abstract")),
        "primary_domain": json_value(topic, "$.domain.display_name"), "primary_field": json_value(topic, "$.field.display_name"),
        "primary_subfield": json_value(topic, "$.subfield.display_name"), "primary_topic": json_value(topic, "$.display_name"),
        "top3_keywords": scored_names(F.col("keywords"), most=3), "keywords": scored_names(F.col("keywords")),
        "top3_concepts": scored_names(F.col("concepts"), most=3), "level0_concepts": scored_names(F.col("concepts"), level=0), "concepts": scored_names(F.col("concepts")),
    })


def clean_works(df: DataFrame, order: str, rules: WorkRules = WorkRules(), prefix: str = "works_") -> DataFrame:
    """One row for each title, its columns prefixed: filters, texts, codes, topics, then what the title's versions have together.

    Rows on a blocklist, without a title, and of things that are no papers go.  A title that occurs more than once loses its rows
    without authors.  Of the rest the first by ``order`` gives the values of one version, the longest value stands for texts,
    listed values are united in order, and the distinct DOIs are columns ``doi_1``, ``doi_2``, and so on.  ``tag``: did the title occur
    more than once?  All of it is one grouped aggregate, so a title of very many rows is summed before it is moved, but for its lists.
    """
    rows = _rows(df, rules)
    used = {"any": F.lit(True), "authored": ~blank(F.col("authors"))}

    def summed(when: Column) -> Column:
        own = F.when(when, F.col(order))
        first = F.min_by(F.struct(*FIRST), own)
        longest = [F.max_by(F.col(c), F.when(when, F.struct(F.length(F.coalesce(F.col(c), F.lit(""))), -F.col(order)))).alias(c) for c in LONGEST]
        united = [F.sort_array(F.collect_list(F.when(when & ~blank(F.col(c)), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))).alias(c) for c in [*UNION, "doi"]]
        return F.struct(first.alias("first"), *longest, *united)

    titles = rows.groupBy("title").agg(F.count("*").alias("n"), F.count_if(used["authored"]).alias("n_authored"), *[summed(when).alias(name) for name, when in used.items()])
    titles = titles.where("n = 1 OR n_authored > 0").select("title", (F.col("n") > 1).cast("int").alias("tag"), F.when(F.col("n") == 1, F.col("any")).otherwise(F.col("authored")).alias("r"))

    def values(c: str) -> Column:
        return F.transform(F.col(f"r.{c}"), lambda x: x["v"])

    made = {c: F.coalesce(F.col(f"r.first.{c}").cast("string"), F.lit("")) for c in FIRST}
    made |= {c: F.trim(F.coalesce(F.col(f"r.{c}"), F.lit(""))) for c in LONGEST}
    made |= {c: F.array_join(F.array_distinct(F.flatten(F.transform(values(c), lambda x: F.split(x, "; ")))), "; ") for c in UNION}
    dois = F.array_distinct(values("doi"))
    made |= {f"doi_{i + 1}": F.coalesce(F.get(dois, F.lit(i)), F.lit("")) for i in range(rules.versions)}
    made["more_dois"] = F.array_join(F.slice(dois, rules.versions + 1, 1_000_000), "; ")
    return titles.select(F.col("title").alias(f"{prefix}title"), F.col("tag").alias(f"{prefix}tag"), *[c.alias(f"{prefix}{name}") for name, c in made.items()])
