"""The cleaning steps of one source, in their order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import DOI_VARIANTS, clean_abstract, clean_text, clean_title, doi_key, is_not_paper, title_key
from .consolidate import drop_blank_author_copies, share_longest
from .filters import kept_in_order, listed


@dataclass(frozen=True)
class SourceRules:
    """What differs between sources: key variants, the journals and years kept, and what is dropped by hand."""

    doi: str = "works"
    title: str = "spaced"
    journals: tuple[str, ...] = ()
    years: tuple[int, int] = (1900, 2100)
    dropped: dict[str, list[object]] = field(default_factory=dict)
    phrases: tuple[str, ...] | None = None


def clean_source(df: DataFrame, rules: SourceRules, order: str) -> DataFrame:
    """Rows ``doi, title, abstract, authors, journal, year`` cleaned: texts and keys, then filters, then duplicates.

    Journals compare by lower-case cleaned name; titles of other things than papers go, rows on a blocklist too; all rows
    of a title share its longest abstract; a row without authors goes where its title occurs again; of each DOI the first
    row by ``order`` stays.
    """
    kept = df.where(F.lower(clean_text(F.col("journal"))).isin(*rules.journals)) if rules.journals else df
    kept = kept.where(F.col("year").between(*rules.years))
    kept = kept.where(~is_not_paper(F.col("title"), list(rules.phrases) if rules.phrases is not None else None))
    kept = kept.where(~listed(rules.dropped)) if rules.dropped else kept
    kept = kept.withColumns({"doi": doi_key(F.col("doi"), **DOI_VARIANTS[rules.doi]), "title": clean_title(F.col("title")), "abstract": clean_abstract(F.col("abstract")), "authors": clean_text(F.col("authors"))})
    kept = kept.withColumn("title_key", title_key(F.col("title"), rules.title))
    kept = share_longest(kept, "title_key", "abstract", order)
    kept = drop_blank_author_copies(kept, "title_key", "authors")
    return kept_in_order(kept, "doi", order)
