"""Text, identifier, date and JSON column functions."""

from __future__ import annotations

import difflib
import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType

# Months in calendar order, name suffixes, and the shares of the DOI prefixes that
# each normalizer removes.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
SUFFIXES = ["jr", "sr", "ii", "iii", "iv"]
DOI_URLS = ["https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/"]
#: Phrases that mark a title as something other than a paper, anywhere in it, in any case.
NOT_PAPERS = [
    "Correction:", "A Correction", "Correction to", "Erratum", "Corrigendum", "comment", "report of", "Editors' Introduction",
    "Editor's Introduction", "Foreword", "reply", "Editorial Announcement", "Ad Hoc Search Committee", "Executive Committee",
    "List of Online Reports", "Book Review", "Frontmatter of Econometrica", "Backmatter of Econometrica ", "Ad Hoc Committee",
    "Journal of Economic Perspectives", "American Economic Journal", "Journal of Economic Literature", "Committee on", "Index to Volume",
    "Recent Referees", "Minutes of the Annual Meeting", "Journal of Political Economy", "John Bates Clark Award", "Appendix",
    "American Economic Association", "American Economic Review", "Job Openings for Economists", "OUP accepted manuscript",
    "Minutes of the Annual Business Meeting", "Front Matter", "The Econometric Society Annual Reports Econometrica",
    "Backmatter of Econometrica", "Accepted Manuscripts", "Acknowledgment of Referees", "Acknowledgement of Referees",
    "Acknowledgment to Referees", "Acknowledgements to Referees", "Abstracts", "Announcements", "Independent Auditors' Report",
    "The Marriage Squeeze Interpretation of Dowry Inflation: Response", "Forthcoming Papers", "Data on Time to First Decision",
    "Election of Fellows to the Econometric Society", "North American Summer Meeting of the Econometric Society",
    "Lucas Prize Announcement", "Back Cover", "News Notes", "Nobel Lecture:", "Meeting of the Econometric Society",
    "Submission of Manuscripts to Econometrica", "Submission Fees and Response Times in Academic Publishing", "Submission of Manuscripts",
    "Subscription Page", "Table of Content", "The Econometric Society Annual Reports", "The Quarterly Journal of Economics",
    "An Astonishing Sixty Years The Legacy of Hiroshima", "the Diamond Water Paradox", "General Information on the Association",
    "Information on the Association", "Private and Social Rates of Return to Education of Academicians Note",
    "Protectionism through Prostitution", "Voltaire on Labor Markets and Monetary Policy", "Fellows of the Econometric Society",
    "Galileo on the Diamond/Water Paradox", "Independent Auditor's Report", "JPE Submissions", "JPE Turnaround Times",
    "JPE Turnaround Times, Previous Two Years", "Referee List", "Title Page", "Editors Introduction", "Editor s Introduction",
    "Editor s Note", "Report by the AEA Data Editor", "AEA Data and Code Availability Policy",
    "Note from the AEA Secretary Treasurer about the Proceedings Supplement", "INDEPENDENT AUDITOR S REPORT", "Independent Auditor s Report",
    "Behavior of the Firm Under Regulatory Constraint", "Auditors Report Audited Financial Statements", "John Bates Clark Medalist",
    "A PHENOMENOLOGICAL STUDY OF TEACHING ROLE PERCEPTIONS OF COLLEGE AND UNIVERSITY PROFESSORS", "International Bibliography of Economics",
]


def clean_text(c: Column) -> Column:
    """White space (Unicode) collapsed and trimmed; null is blank."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " "))


def clean_markup(c: Column) -> Column:
    """Tags removed, white space collapsed, null markers blank."""
    text = clean_text(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " "))
    return F.when(text.isin(r"\N", "NULL", "nan", "None"), "").otherwise(text)


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """HTML character references decoded, at most three times over."""

    def decode(x: str | None) -> str | None:
        for _ in range(3):
            if x is None or (y := html.unescape(x)) == x:
                return x
            x = y
        return x

    return s.map(decode)


@F.pandas_udf(StringType())
def to_ascii(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without what is not ASCII."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def letters_and_numbers(c: Column, ascii_only: bool = False) -> Column:
    """Everything else becomes one space; case is kept."""
    other = "[^A-Za-z0-9]+" if ascii_only else r"[^\p{L}\p{N}]+"
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), other, " "))


def title_key(c: Column, variant: str) -> Column:
    """``compact``: lower case, letters and numbers only; ``spaced``: ampersands as words, others as spaces;
    ``ascii``: lower case, a-z and 0-9, others as spaces."""
    low = F.lower(clean_text(c))
    if variant == "compact":
        return F.regexp_replace(low, r"[^\p{L}\p{N}]", "")
    if variant == "spaced":
        low = F.replace(F.replace(low, F.lit("&amp;"), F.lit(" and ")), F.lit("&"), F.lit(" and "))
        return F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))
    if variant == "ascii":
        return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))
    raise ValueError(f"unknown variant {variant!r}")


def clean_title(c: Column) -> Column:
    """Without sales and access suffixes and a trailing star."""
    text = F.regexp_replace(clean_text(c), r"(?i)\s+Available for Purchase$", "")
    text = F.regexp_replace(text, r"(?i)\s+Open Access$", "")
    return clean_text(F.regexp_replace(text, r"\s*\*$", ""))


def doi_key(c: Column, urls: tuple[str, ...] = tuple(DOI_URLS), where: str = "anywhere", doi_word: bool = False, lower: bool = True, strip: str = "", none: str = "") -> Column:
    """A DOI without its URL; the sources' normalizers differ in the parameters.

    ``where``: ``anywhere`` or ``start``; ``doi_word``: also drop ``doi:``; ``strip``: characters
    dropped at the end; ``none``: a text that stands for no DOI.
    """
    text = clean_text(c)
    text = F.when(text == none, "").otherwise(text) if none else text
    text = F.lower(text) if lower else text
    for url in [*urls, *["doi:"] * doi_word]:
        if where == "start":
            text = F.when(text.startswith(url), F.substr(text, F.lit(len(url) + 1))).otherwise(text)
        else:
            text = F.replace(text, F.lit(url), F.lit(""))
    text = F.trim(text)
    return F.rtrim(text, F.lit(strip)) if strip else text


#: The sources' DOI normalizers, as parameters of :func:`doi_key`.
DOI_VARIANTS = {
    "works": {"urls": (DOI_URLS[0], DOI_URLS[1], DOI_URLS[3]), "lower": False},
    "scrape": {"urls": (DOI_URLS[0], DOI_URLS[1], DOI_URLS[3])},
    "prefix": {"where": "start", "doi_word": True},
    "all": {"urls": (DOI_URLS[0], DOI_URLS[1], DOI_URLS[3]), "strip": ".,;"},
    "papers": {"doi_word": True, "strip": ".,;"},
    "records": {"where": "start", "doi_word": True, "strip": "."},
    "collected": {"urls": (DOI_URLS[0], DOI_URLS[3])},
    "working": {"urls": (DOI_URLS[0], DOI_URLS[1], DOI_URLS[3]), "strip": ".,;", "none": "NULL"},
}


def name_key(c: Column) -> Column:
    """Lower case a-z and 0-9 only."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9]", "")


def without_suffix(c: Column) -> Column:
    """A name without generational suffixes at its end."""
    return F.regexp_replace(clean_text(c), r"(?i)([\s,]+(jr\.?|sr\.?|ii|iii|iv))+$", "")


def first_last(c: Column) -> tuple[Column, Column]:
    """``(first, last)`` of a full name; one token is a last name."""
    tokens = F.split(without_suffix(c), " ")
    many = F.size(tokens) > 1
    return F.when(many, F.element_at(tokens, 1)).otherwise(""), F.element_at(tokens, -1)


def reverse_comma(c: Column) -> Column:
    """``Last, First`` as ``First Last``; only the first comma counts."""
    return clean_text(F.regexp_replace(c, "^([^,]*),(.*)$", "$2 $1"))


def is_not_paper(title: Column, phrases: list[str] | None = None) -> Column:
    """Does the title hold one of the phrases, in any case?"""
    low = F.lower(F.coalesce(title, F.lit("")))
    words = F.array(*[F.lit(x.lower()) for x in phrases or NOT_PAPERS])
    return F.exists(words, lambda w: F.contains(low, w))


def year_in(c: Column, last: bool = False) -> Column:
    """The first (or last) year 1900-2099 in a text; blank if there is none."""
    if last:
        return F.coalesce(F.element_at(F.nullif(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), F.array().cast("array<string>")), -1), F.lit(""))
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"\b((19|20)\d{2})\b", 1)


def month_in(c: Column) -> Column:
    """The first month, in calendar order, whose name the text holds."""
    out = F.lit(None).cast("int")
    for i in range(12, 0, -1):
        out = F.when(F.contains(F.lower(c), F.lit(MONTHS[i - 1].lower())), i).otherwise(out)
    return out


def code_letters(c: Column, digits: str = r"(?:\d{2})?") -> Column:
    """Distinct first letters of classification codes, in order."""
    found = F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit(rf"\b[A-Z]{digits}\b"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.substring(x, 1, 1)))


#: Fixed value: how classification codes are announced, in any case.
CODE_LABEL = r"(?:JEL|JEL\s+classification|JEL\s+classifications|JEL\s+codes?|JEL\s+No\.?)"
_CODES = r"[A-Z][0-9]{2}(?:\s*[,;/]\s*[A-Z][0-9]{2})*"


def announced_codes(c: Column) -> Column:
    """Distinct codes (a letter, two digits) that follow an announcement within 50 other characters, in order, upper case."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")
    lists = F.regexp_extract_all(plain, F.lit(rf"(?i){CODE_LABEL}[^A-Za-z0-9]{{0,50}}({_CODES})"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(F.upper(x), F.lit(r"\b[A-Z][0-9]{2}\b"), F.lit(0)))))


def nearby_codes(c: Column, reach: int = 500) -> Column:
    """Announced codes, else distinct codes within ``reach`` characters after the first ``JEL``."""
    text = clean_text(c)
    at = F.instr(F.lower(text), "jel")
    near = F.when(at > 0, F.upper(F.substr(text, at, F.lit(reach)))).otherwise("")
    found = F.array_distinct(F.regexp_extract_all(near, F.lit(r"\b[A-Z][0-9]{2}\b"), F.lit(0)))
    own = announced_codes(text)
    return F.when(F.size(own) > 0, own).otherwise(found)


def without_codes(c: Column) -> Column:
    """Without announcements of codes, up to the codes' end."""
    text = F.regexp_replace(c, rf"(?i){CODE_LABEL}[^.;\n]*{_CODES}\.?", " ")
    return F.regexp_replace(text, r"(?i)Classification-JEL:[^.;\n]*\.?", " ")


def clean_abstract(c: Column, label: bool = False) -> Column:
    """References decoded, without tags and announced codes; ``label``: also without a leading ``Abstract``."""
    text = clean_text(without_codes(F.regexp_replace(unescape(clean_text(c)), "<[^>]+>", " ")))
    return F.regexp_replace(text, r"(?i)^abstract[\s:.]*", "") if label else text


def has_code(codes: Column, predicted: Column, by: str = ";") -> Column:
    """Is the predicted label, if there is one, among the delimited codes?"""
    each = F.transform(F.split(F.coalesce(codes, F.lit("")), by), lambda x: F.trim(x))
    own = F.trim(F.coalesce(predicted, F.lit("")))
    return (own != "") & F.array_contains(each, own)


def number(c: Column) -> Column:
    """A double, or null where the text is none."""
    return c.try_cast("double")


def whole(c: Column) -> Column:
    """An integer by way of double (``2015.0`` is 2015), or null."""
    return c.try_cast("double").try_cast("int")


def safe_share(a: Column, b: Column) -> Column:
    """``a / b``, 0 where ``b`` is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def softmax(array: Column) -> Column:
    """Of an array of doubles, shifted by its maximum."""
    e = F.transform(array, lambda x: F.exp(x - F.array_max(array)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, v: a + v))


def inverted_index(words: Column) -> Column:
    """JSON map from word to positions (from 0) of an array of words, by sorting: no row meets another."""
    placed = F.sort_array(F.transform(words, lambda x, i: F.struct(x.alias("word"), i.alias("at"))))

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["word"] != F.get(s, i - 1)["word"]))
        return _let(starts, lambda at: F.transform(at, lambda i, n: _entry(s, i, F.coalesce(F.get(at, n + 1), F.size(s)))))

    return F.when(F.size(words) > 0, F.to_json(F.map_from_entries(_let(placed, runs)))).otherwise("{}")


def _entry(s: Column, start: Column, end: Column) -> Column:
    return F.struct(F.get(s, start)["word"].alias("word"), F.transform(F.slice(s, start + 1, end - start), lambda p: p["at"]).alias("places"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def inverted_index_text(c: Column) -> Column:
    """Text of a JSON map from word to positions."""
    entries = F.map_entries(F.from_json(c, "map<string,array<int>>"))
    places = F.flatten(F.transform(entries, lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.sort_array(places), lambda p: p["word"]), " ")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; not symmetric, so the order of the arguments matters."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(IntegerType())
def common_substring_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common substring."""

    def longest(x: str, y: str) -> int:
        best, row = 0, [0] * (len(y) + 1)
        for ch in x:
            above = 0
            for j, other in enumerate(y, 1):
                row[j], above = (above + 1 if ch == other else 0), row[j]
                best = max(best, row[j])
        return best

    return pd.Series([longest(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int32")
