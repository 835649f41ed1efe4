"""Nested records as JSON text: names, scores, authorships, dates and identifiers."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import blank, nonblank
from .text import clean_text

NAMED = "array<struct<display_name:string,score:double,level:int>>"
#: Fixed value: the fields of a record that may hold its date, in the order in which they are tried.
DATE_FIELDS = ["published", "published-print", "published-online", "issued", "created"]


def json_value(c: Column, path: str) -> Column:
    """One value of a JSON text; blank where it is missing or the text is no JSON."""
    return F.coalesce(F.get_json_object(c, path), F.lit(""))


def first_json_value(c: Column) -> Column:
    """The first element of a JSON array, or the text itself if it is none; blank if there is nothing."""
    array = F.from_json(c, "array<string>")
    return F.coalesce(F.when(F.startswith(F.trim(c), F.lit("[")), F.get(array, 0)).otherwise(F.trim(c)), F.lit(""))


def joined_json(c: Column, by: str = "; ") -> Column:
    """The non-blank elements of a JSON array of texts, joined."""
    return F.coalesce(F.array_join(F.filter(F.from_json(c, "array<string>"), lambda x: ~blank(x)), by), F.lit(""))


def scored_names(c: Column, most: int | None = None, level: int | None = None) -> Column:
    """``name (0.123); name`` of a JSON array of named, scored items: the first ``most``, of one ``level``; nameless ones are left out."""
    items = F.from_json(c, NAMED)
    if level is not None:
        items = F.filter(items, lambda x: x["level"] == level)
    if most is not None:
        items = F.slice(items, 1, most)

    def shown(x: Column) -> Column:
        return F.when(x["score"].isNull(), x["display_name"]).otherwise(F.format_string("%s (%.3f)", x["display_name"], x["score"]))

    named = F.filter(items, lambda x: F.coalesce(x["display_name"], F.lit("")) != "")
    return F.coalesce(F.array_join(F.transform(named, shown), "; "), F.lit(""))


def plain_keyword(c: Column) -> Column:
    """A scored name without its score and other parentheses."""
    return clean_text(F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^)]*\)", " "))


AUTHORSHIPS = """array<struct<author:struct<display_name:string,id:string>,raw_author_name:string,raw_orcid:string,author_position:string,
institutions:array<struct<display_name:string,id:string>>,raw_affiliation_strings:array<string>>>"""


def _list(items: Column) -> Column:
    """Non-blank values, trimmed, as one cell; blank ones leave no gap, so lists of one record may differ in length."""
    return F.coalesce(F.array_join(F.transform(F.filter(items, lambda x: ~blank(x)), lambda x: F.trim(x)), "; "), F.lit(""))


def _inner(items: Column) -> Column:
    return F.coalesce(F.array_join(F.filter(items, lambda x: F.coalesce(x, F.lit("")) != ""), " | "), F.lit(""))


def authorship_lists(df: DataFrame, json: str) -> DataFrame:
    """Eight parallel cells of a record's authorships."""
    rows = df.withColumn("_a", F.from_json(json, AUTHORSHIPS))
    each = {
        "authors": lambda x: x["author"]["display_name"],
        "author_ids": lambda x: x["author"]["id"],
        "raw_author_names": lambda x: x["raw_author_name"],
        "orcid_ids": lambda x: x["raw_orcid"],
        "author_positions": lambda x: x["author_position"],
        "author_institutions": lambda x: _inner(F.transform(x["institutions"], lambda i: i["display_name"])),
        "author_institution_ids": lambda x: _inner(F.transform(x["institutions"], lambda i: i["id"])),
        "raw_affiliation_strings": lambda x: _inner(x["raw_affiliation_strings"]),
    }
    return rows.withColumns({k: _list(F.transform("_a", f)) for k, f in each.items()}).drop("_a")


PERSONS = "array<struct<given:string,family:string,name:string,sequence:string,ORCID:string,affiliation:array<struct<name:string>>>>"


def person_lists(df: DataFrame, json: str) -> DataFrame:
    """Six parallel cells of a record's persons; a missing name is made of given and family name."""
    rows = df.withColumn("_p", F.from_json(json, PERSONS))
    each = {
        "authors": lambda x: F.coalesce(nonblank(clean_text(x["name"])), clean_text(F.concat_ws(" ", clean_text(x["given"]), clean_text(x["family"])))),
        "author_given": lambda x: clean_text(x["given"]),
        "author_family": lambda x: clean_text(x["family"]),
        "author_sequence": lambda x: x["sequence"],
        "author_affiliations": lambda x: _inner(F.transform(x["affiliation"], lambda i: clean_text(i["name"]))),
        "author_orcids": lambda x: x["ORCID"],
    }
    return rows.withColumns({k: _list(F.transform("_p", f)) for k, f in each.items()}).drop("_p")


def date_year(c: Column) -> Column:
    """The year of the first field that has one, of a JSON record with nested date parts; null if none."""
    return F.coalesce(*[F.get_json_object(c, f"$['{f}']['date-parts'][0][0]").try_cast("int") for f in DATE_FIELDS])


def date_text(c: Column, field: str) -> Column:
    """``yyyy``, ``yyyy-mm`` or ``yyyy-mm-dd`` of a field's date parts; blank if there is no year."""
    parts = [F.get_json_object(c, f"$['{field}']['date-parts'][0][{i}]").try_cast("int") for i in range(3)]
    year, month, day = (F.format_string(f"%0{w}d", p) for w, p in zip((4, 2, 2), parts, strict=True))
    full = F.concat_ws("-", year, F.when(parts[1].isNotNull(), month), F.when(parts[1].isNotNull() & parts[2].isNotNull(), day))
    return F.when(parts[0].isNull(), "").otherwise(full)


def date_or_blank(c: Column) -> Column:
    """``yyyy-mm-dd`` of a date text; blank where it is no date."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd"), F.lit(""))


def likely_year(c: Column, last: int | None = None) -> Column:
    """The first year from 1900 to next year (or ``last``) that leads the years in a text; blank otherwise."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"\b(?:19\d{2}|20\d{2})\b", 0)
    return F.when(found.try_cast("int") <= (last or datetime.date.today().year + 1), found).otherwise("")


def year_from_path(c: Column) -> Column:
    """The last four digits in a path's file name that are a year; null if none."""
    name = F.element_at(F.split(c, "/"), -1)
    return F.element_at(F.nullif(F.regexp_extract_all(name, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1)), F.array().cast("array<string>")), -1).try_cast("int")


def paper_identifier(doi: Column, title: Column) -> Column:
    """The DOI, else the title, trimmed."""
    return F.coalesce(nonblank(doi), nonblank(title), F.lit(""))


def paper_doi(paper: Column, prefix: str = "10.3386/") -> Column:
    """The DOI of a numbered working paper; blank if it has no such number."""
    own = F.lower(clean_text(paper))
    return F.when(F.rlike(own, F.lit(r"^w\d+$")), F.concat(F.lit(prefix), own)).otherwise("")


def work_id(c: Column) -> Column:
    """A work's identifier: trimmed, lower case."""
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def address(*pieces: Column) -> Column:
    """Distinct pieces in order, without blanks and null marks."""
    return F.array_join(F.array_distinct(F.filter(F.array(*[clean_text(p) for p in pieces]), lambda x: ~x.isin("", r"\N"))), "; ")


def named_address(name: Column, where: Column) -> Column:
    """``name: address``, or the address alone."""
    return F.when(~blank(name) & ~blank(where), F.concat(clean_text(name), F.lit(": "), clean_text(where))).otherwise(clean_text(where))


def walk(df: DataFrame, json: str, keep: list[str], depth: int = 12) -> DataFrame:
    """``path, value`` of every scalar in a JSON text, at any depth up to ``depth`` (more is an error), with the columns ``keep``.

    Objects and arrays are opened level by level; each level is one explode of what is still open.
    """
    open_ = df.select(*keep, F.lit("$").alias("path"), F.try_parse_json(json).alias("v"))
    done: DataFrame | None = None
    for _ in range(depth):
        kind = F.schema_of_variant("v")
        nested = F.startswith(kind, F.lit("OBJECT<")) | F.startswith(kind, F.lit("ARRAY<"))
        flat = open_.where(~F.coalesce(nested, F.lit(False))).select(*keep, "path", F.try_variant_get("v", "$", "string").alias("value"))
        done = flat if done is None else done.union(flat)
        own = ", ".join(f"w.`{k}`" for k in keep)
        open_ = df.sparkSession.sql(f"SELECT {own}{', ' if own else ''}concat(w.path, coalesce(concat('.', e.key), concat('[', cast(e.pos AS string), ']'))) AS path, e.value AS v FROM {{nested}} w, LATERAL variant_explode(w.v) e", nested=open_.where(nested))
    deeper = F.when(F.col("path").isNotNull(), F.raise_error(F.lit(f"JSON deeper than {depth} levels")).cast("string"))
    return done.union(open_.select(*keep, "path", deeper.alias("value")))
