"""Person names: cleaning variants, promotion of initials, corrections, comparison."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import clean_text, to_ascii

#: Fixed value: degrees that count as doctoral, in any case.
DOCTORAL = r"(?i)(?:\bph\.?\s*d\.?\b|\bd\.?\s*phil\.?\b|\bdoctor(?:ate|al)\b|\bdoctor\s+of\s+philosophy\b|\bdoctor\s+of\s+economics\b|\bdoctorat\b|\bdr\.?\s*rer\.?\s*pol\.?\b)"


def name_part(c: Column) -> Column:
    """Without full stops and commas."""
    return clean_text(F.translate(clean_text(c), ".,", ""))


def display_name(c: Column) -> Column:
    """ASCII letters only; anything else becomes one space."""
    return clean_text(F.regexp_replace(to_ascii(F.coalesce(c, F.lit(""))), "[^A-Za-z]+", " "))


def name_versions(c: Column) -> Column:
    """A name text with references decoded elsewhere: no-break spaces and line ends are white space, collapsed."""
    return clean_text(F.translate(F.coalesce(c, F.lit("")), " \r\n\t", "    "))


def first_sequence(c: Column) -> Column:
    """The first token; blank if there is none."""
    return F.element_at(F.split(clean_text(c), " "), 1)


def last_sequence(c: Column) -> Column:
    """The last token; blank if there is none."""
    return F.element_at(F.split(clean_text(c), " "), -1)


def without_junior(c: Column) -> Column:
    """Without ``Jr`` or ``Jr.`` anywhere, and the comma before it."""
    return clean_text(F.regexp_replace(clean_text(c), r",\s*Jr\.?|\bJr\.?", ""))


def _promoted(author: Column, own: Column, other: Column, place: int) -> Column:
    """``own``, or if it is one letter the author's token at ``place``, unless that is blank, one letter or ``other``."""
    tokens = F.split(clean_text(author), " ")
    near = name_part(F.try_element_at(tokens, F.lit(place)))
    better = (F.length(own) == 1) & (F.size(tokens) >= 2) & (F.length(near) > 1) & (near != other)
    return F.when(better, near).otherwise(own)


def promoted_first(author: Column, first: Column, last: Column) -> Column:
    """A first name of one letter gives way to the author's second token."""
    return _promoted(author, first, last, 2)


def promoted_last(author: Column, first: Column, last: Column) -> Column:
    """A last name of one letter gives way to the author's last token but one."""
    return _promoted(author, last, first, -2)


def corrected(c: Column, exact: dict[str, str] | None = None, inside: dict[str, str] | None = None, keyed: tuple[Column, dict[str, dict[str, str]]] | None = None) -> Column:
    """Manual corrections: ``keyed`` (a key's own exact corrections) first, then ``inside`` (substrings), then ``exact`` (whole values)."""
    out = c
    if keyed:
        key, by_key = keyed
        for k, changes in by_key.items():
            for old, new in changes.items():
                out = F.when((key == k) & (c == old), F.lit(new)).otherwise(out)
    for old, new in (inside or {}).items():
        out = F.replace(out, F.lit(old), F.lit(new))
    if exact:
        out = F.coalesce(F.create_map(*[F.lit(x) for kv in exact.items() for x in kv])[out], out)
    return out


def full_name(first: Column, last: Column) -> Column:
    """First and last name with one space, blank parts left out."""
    return clean_text(F.concat_ws(" ", clean_text(first), clean_text(last)))


def is_doctoral(c: Column) -> Column:
    """Is the degree a doctorate?"""
    return F.rlike(F.coalesce(c, F.lit("")), F.lit(DOCTORAL))


#: Shares of the family and the given names in a likeness, the family likeness below which given names don't
#: count, and what contained family names, begun given names and initials are worth.
FAMILY_SHARE, GIVEN_SHARE, FAMILY_DECIDES = 0.68, 0.32, 0.72
CONTAINED, BEGUN, INITIAL = 0.9, 0.9, 0.82


def name_words(folded: Column) -> Column:
    """The runs of ASCII letters of a folded name, lower case."""
    return F.regexp_extract_all(F.lower(folded), F.lit("[a-z]+"), F.lit(0))


@F.pandas_udf(DoubleType())
def best_ratio(name: pd.Series, others: pd.Series) -> pd.Series:
    """The highest sequence ratio of a name with any of an array's; null without any."""
    ratios = [[difflib.SequenceMatcher(None, a, b).ratio() for b in bs] if bs is not None else [] for a, bs in zip(name, others, strict=True)]
    return pd.Series([max(x, default=None) for x in ratios], dtype="float64")


@F.pandas_udf(DoubleType())
def rounded(c: pd.Series) -> pd.Series:
    """To four places, by the number's exact binary value (which a decimal text of it may round otherwise)."""
    return c.map(lambda x: round(x, 4))


def with_person_similarity(df: DataFrame, first: Column, last: Column, candidate: Column, out: str = "similarity") -> DataFrame:
    """``out``: how alike a first and last name and a candidate's name are, from 0 to 1.

    The candidate's family words stand before its comma, or are as many at its end as ``last`` has.  Family names, written
    together, are worth 1 if equal, ``CONTAINED`` if one holds the other, else their sequence ratio.  The first given word
    is compared with every other word of the candidate, and the best counts: 1 if equal, ``INITIAL`` for a matching initial,
    ``BEGUN`` if one begins with the other, else the ratio.  Only what these rules leave open is compared letter by letter.
    """
    own, c = df.columns, F.col("_candidate")
    blank = F.lit("")
    folded = df.withColumn("_candidate", F.coalesce(candidate, blank)).withColumns({"_first": to_ascii(F.coalesce(first, blank)), "_last": to_ascii(F.coalesce(last, blank)), "_all": to_ascii(c), "_before": to_ascii(F.substring_index(c, ",", 1)), "_after": to_ascii(F.substr(c, F.instr(c, ",") + 1))})

    words = folded.withColumns({"_wanted": name_words(F.col("_last")), "_given": F.coalesce(F.get(name_words(F.col("_first")), F.lit(0)), blank), "_words": name_words(F.col("_all"))})
    start = F.greatest(F.lit(0), F.size("_words") - F.size("_wanted"))
    comma = F.contains(c, F.lit(","))
    words = words.withColumns({
        "_family": F.when(comma, name_words(F.col("_before"))).otherwise(F.slice("_words", start + 1, F.size("_words"))),
        "_rest": F.when(comma, name_words(F.col("_after"))).otherwise(F.slice("_words", 1, start)),
    })

    a, b, given = F.array_join("_wanted", ""), F.array_join("_family", ""), F.col("_given")

    def worth(x: Column) -> Column:
        one, same = F.least(F.length(x), F.length(given)) == 1, F.substring(x, 1, 1) == F.substring(given, 1, 1)
        value = F.when(x == given, 1.0).when(one & same, INITIAL).when(F.startswith(x, given) | F.startswith(given, x), BEGUN)
        return F.struct(x.alias("word"), value.alias("value"))

    ruled = words.withColumns({"_a": a, "_b": b, "_sure": F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), CONTAINED), "_worths": F.transform("_rest", worth)})
    near = ruled.withColumn("_near", F.coalesce("_sure", best_ratio("_a", F.when(F.col("_sure").isNull(), F.array("_b")))))
    near = near.withColumn("_known", F.coalesce(F.array_max(F.transform("_worths", lambda x: x["value"])), F.lit(0.0)))
    open_ = (given != "") & (F.col("_known") < 1.0) & (F.col("_near") >= FAMILY_DECIDES)
    unsure = F.transform(F.filter("_worths", lambda x: x["value"].isNull()), lambda x: x["word"])
    best = near.withColumn("_best", F.when(given == "", 0.0).otherwise(F.greatest("_known", F.coalesce(best_ratio("_given", F.when(open_, unsure)), F.lit(0.0)))))
    family = F.lit(FAMILY_SHARE) * F.col("_near")
    whole = F.when(F.col("_near") < FAMILY_DECIDES, family).otherwise(F.least(F.lit(1.0), family + F.lit(GIVEN_SHARE) * F.col("_best")))
    scored = best.withColumn(out, rounded(F.when((F.size("_wanted") == 0) | (c == ""), 0.0).otherwise(whole)))
    return scored.select(*[x for x in own if x != out], out)


def orcid(c: Column) -> Column:
    """The first identifier in a text, upper case; blank if none."""
    return F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)\b\d{4}-\d{4}-\d{4}-\d{3}[\dX]\b", 0))


def orcid_query(first: Column, last: Column) -> Column:
    """The search for a person's name; backslashes and quotes are escaped."""

    def quoted(c: Column) -> Column:
        return F.replace(F.replace(clean_text(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

    return F.concat(F.lit('given-names:"'), quoted(first), F.lit('" AND family-name:"'), quoted(last), F.lit('"'))


def safe_filename(c: Column) -> Column:
    """Lower case; runs of anything but letters and digits are one dash."""
    return F.trim(F.regexp_replace(F.lower(clean_text(c)), "[^a-z0-9]+", "-"), F.lit("-"))
