"""Page metadata: titles, headings, meta tags and language, by an Arrow function over raw pages."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.markup import TolerantParser


class _Meta(TolerantParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: dict[str, str] = {}
        self.metas: dict[str, list[str]] = {}
        self.at = ""
        self.marked: dict[str, list[list[str]]] = {}
        self.open: list[tuple[str, str | None]] = []
        self.tags: Counter[str] = Counter()  # of open elements
        self.fields: Counter[str] = Counter()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.found.setdefault("lang", values.get("lang", ""))
        elif tag == "meta":
            if "charset" in values:
                self.found.setdefault("charset", values["charset"])
            name = (values.get("name") or values.get("property") or "").lower()
            if name:
                self.metas.setdefault(name, []).append(" ".join(values.get("content", "").split()))
        elif tag in ("title", "h1") and tag not in self.found:
            self.at = tag
            self.found[tag] = ""
        if tag not in _VOID:
            words = set(f"{values.get('class', '')} {values.get('id', '')}".lower().replace("_", "-").split())
            field = next((f for f, names in SELECTORS.items() if words & set(names)), None)
            self.open.append((tag, field))
            self.tags[tag] += 1
            if field:
                self.fields[field] += 1
                self.marked.setdefault(field, []).append([])

    def handle_endtag(self, tag: str) -> None:
        if tag == self.at:
            self.at = ""
        last = "" if self.tags[tag] else tag
        while last != tag:
            last, field = self.open.pop()
            self.tags[last] -= 1
            if field:
                self.fields[field] -= 1

    def handle_data(self, data: str) -> None:
        if self.at:
            self.found[self.at] += data
        for field in +self.fields:
            self.marked[field][-1].append(data)

    def selected(self, field: str) -> str:
        """The field's marked elements, for pages without its meta tags."""
        return "; ".join(dict.fromkeys(filter(None, (" ".join("".join(x).split()) for x in self.marked.get(field, [])))))

    def first(self, *names: str) -> str:
        return next((x for n in names for x in self.metas.get(n, []) if x), "")


#: Meta names of each field, in the order in which they are tried.
META = {
    "title": ("citation_title", "dc.title", "og:title"),
    "year": ("citation_publication_date", "citation_date", "dc.date"),
    "abstract": ("citation_abstract", "dc.description", "description", "og:description"),
    "keywords": ("citation_keywords", "keywords", "dc.subject"),
    "doi": ("citation_doi", "dc.identifier"),
}
#: Class and id words of elements that hold a field, where no meta tag does.
SELECTORS = {
    "authors": ("author", "authors", "author-name", "contributor"),
    "abstract": ("abstract", "article-abstract", "abstract-text"),
    "keywords": ("keywords", "keyword", "article-keywords"),
    "codes": ("jel", "jel-codes", "jel-classification"),
}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CODE = re.compile(r"\b[A-Z][0-9]{2}\b")
_ANNOUNCED = re.compile(r"JEL(?:\s+(?:classifications?|codes?|No\.?))?[^A-Za-z0-9]{0,50}([A-Z][0-9]{2}(?:\s*[,;/]\s*[A-Z][0-9]{2})*)", re.I)
FIELDS = ["codes", "title", "h1", "lang", "charset", "authors", "institutions", "year", "abstract", "keywords", "doi"]


def metadata(page: str) -> dict[str, str]:
    """Metadata of one page; a page title stands in for a missing meta title."""
    m = _Meta()
    m.read(page)
    text = {k: " ".join(v.split()) for k, v in m.found.items()}
    out = {"h1": text.get("h1", ""), "lang": text.get("lang", ""), "charset": text.get("charset", "")}
    out |= {k: m.first(*names) for k, names in META.items()}
    out["title"] = out["title"] or text.get("title", "")
    out["authors"] = "; ".join(dict.fromkeys(filter(None, m.metas.get("citation_author", []) or m.metas.get("author", []))))
    out["authors"] = out["authors"] or m.selected("authors")
    for f in ("abstract", "keywords"):
        out[f] = out[f] or m.selected(f)
    announced = m.selected("codes") or " ".join(x[1] for x in _ANNOUNCED.finditer(page))
    out["codes"] = "; ".join(dict.fromkeys(_CODE.findall(announced.upper())))
    out["institutions"] = "; ".join(dict.fromkeys(filter(None, m.metas.get("citation_author_institution", []))))
    return out


@F.pandas_udf(StructType([StructField(f, StringType()) for f in FIELDS]))
def page_metadata(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([metadata(p or "") for p in pages], columns=FIELDS)
