"""Quality rules: a table of thresholds, compiled into projections of built-in functions.

Every rule bounds a measure by a share, in percent, of another measure: ``least * per <= 100 * measure <= most * per``.
All sides are whole numbers, so no rule depends on rounding.  The measures of a text are expressions over its
words (runs of anything but ASCII white space) and its lines with a word; they and the rules are two projections over
the table, without user functions, joins or shuffles.

Repeated three-word windows are found within the row: marks of the windows are sorted, neighbours that are alike are
candidates, and the candidates' words are sorted and compared, so the work grows with the text's length times its logarithm.

Edge cases: a null text has no words, and fails; so does every text of fewer than ``least_words`` words.  Rows without
doc_id and repeated rows are judged like any other; an empty table gives no rows.  Other columns pass through
:func:`judge_rules` unless they bear a name of the result's, which the result takes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: The most frequent function words of the corpus's languages, as any grammar lists them.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "this", "by", "be", "are", "from", "at", "have"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "dem", "im", "nicht", "ein", "eine", "als"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "pour", "est", "dans", "qui", "par", "sur", "pas", "au", "avec"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "las", "del", "un", "por", "con", "no", "una", "su", "para", "al", "es", "lo"],
}


@dataclass(frozen=True)
class Rule:
    """``least`` and ``most``: bounds of the measure in percent of ``per``; null is no bound."""

    name: str
    measure: str
    per: str
    least: int | None = None
    most: int | None = None


RULES = [
    Rule("short words", "word_chars", "n_words", least=300),
    Rule("long words", "word_chars", "n_words", most=1000),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("words without letters", "n_unlettered", "n_words", most=20),
    Rule("words that end in repeated marks", "n_shouted", "n_words", most=10),
    Rule("stop words", "n_stop_words", "n_words", least=4),
    Rule("repeated lines", "n_dup_lines", "n_lines", most=30),
    Rule("lines that break off", "n_broken_lines", "n_lines", most=30),
    Rule("listed lines", "n_listed_lines", "n_lines", most=90),
]


@dataclass(frozen=True)
class RuleParams:
    rules: tuple[Rule, ...] = tuple(RULES)
    least_words: int = 50
    most_repeated: int = 50  # percent of all words that lie in repeated three-word windows
    stop_words: tuple[str, ...] = tuple(sorted({w for words in STOP_WORDS.values() for w in words}))


def _neighbours(c: Column, same: Callable[[Column, Column], Column], place: Callable[[Column], Column]) -> Column:
    """Distinct places of the elements of a sorted array that are alike with a neighbour."""
    n = F.greatest(F.size(c) - 1, F.lit(0))
    met = F.zip_with(F.slice(c, 1, n), F.slice(c, 2, n), lambda x, y: F.when(same(x, y), F.array(place(x), place(y))))
    return F.array_distinct(F.flatten(F.filter(met, lambda x: x.isNotNull())))


def measured(docs: DataFrame, p: RuleParams = RuleParams()) -> DataFrame:
    """``docs`` with the measures that rules can name, as longs."""
    words, lines, marks, places = fresh(docs, "_words", "_lines", "_marks", "_places")
    new = ["n_words", "word_chars", "n_symbols", "n_unlettered", "n_shouted", "n_stop_words", "n_lines", "n_dup_lines", "n_broken_lines", "n_listed_lines", "n_repeat_words"]
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(*own, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias(words), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias(lines))
    w, ln = F.col(words), F.col(lines)
    # A window is marked by 33 bits of its hash before the 31 of its place: longs sort fast, and like marks are candidates.
    high, low = F.lit(-(1 << 31)).cast("long"), F.lit((1 << 31) - 1).cast("long")
    mark = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long")))
    counted = split.select(
        *own,
        w,
        F.sort_array(mark).alias(marks),
        F.size(w).alias("n_words"),
        F.length(F.array_join(w, "")).alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).alias("n_symbols"),
        F.size(F.filter(w, lambda x: ~x.rlike(r"\p{L}"))).alias("n_unlettered"),
        F.size(F.filter(w, lambda x: x.endswith("!!") | x.endswith("??"))).alias("n_shouted"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*p.stop_words))).alias("n_stop_words"),
        F.size(ln).alias("n_lines"),
        (F.size(ln) - F.size(F.array_distinct(ln))).alias("n_dup_lines"),
        F.size(F.filter(ln, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).alias("n_broken_lines"),
        F.size(F.filter(ln, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•][\x20\x09-\x0D]"))).alias("n_listed_lines"),
    )
    candidates = _neighbours(F.col(marks), lambda x, y: x.bitwiseAND(high) == y.bitwiseAND(high), lambda x: x.bitwiseAND(low).cast("int"))
    found = counted.withColumn(places, candidates).drop(marks)
    # Only candidates' words are compared.
    window = F.sort_array(F.transform(places, lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))))
    found = found.withColumn(places, window)
    repeated = _neighbours(F.col(places), lambda x, y: (x["c"] == y["c"]) & (x["b"] == y["b"]) & (x["a"] == y["a"]), lambda x: x["i"])
    covered = F.array_distinct(F.flatten(F.transform(repeated, lambda i: F.array(i, i + 1, i + 2))))
    return found.select(*own, *[F.col(c).cast("long").alias(c) for c in new[:-1]], F.size(covered).cast("long").alias(new[-1]))


def judge_rules(docs: DataFrame, p: RuleParams = RuleParams()) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, the names of the rules it fails (``failed_rules``) and ``kept``.

    ``base_failed``: fewer than ``least_words`` words, or over ``most_repeated`` percent of the words in repeated
    windows.  ``kept``: neither the base nor any rule fails.
    """
    taken = {"base_failed", "failed_rules", "kept"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])
    broken = []
    for r in p.rules:
        bounds = [100 * F.col(r.measure) < r.least * F.col(r.per)] if r.least is not None else []
        bounds += [100 * F.col(r.measure) > r.most * F.col(r.per)] if r.most is not None else []
        for bad in bounds:
            broken.append(F.when(bad, F.lit(r.name)))
    base = (F.col("n_words") < p.least_words) | (100 * F.col("n_repeat_words") > p.most_repeated * F.col("n_words"))
    failed = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    rows = measured(docs, p).withColumns({"base_failed": base, "failed_rules": failed})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def _sql_bounds(r: Rule) -> list[str]:
    return [f"100 * {r.measure} >= {r.least} * {r.per}"] * (r.least is not None) + [f"100 * {r.measure} <= {r.most} * {r.per}"] * (r.most is not None)


def rules_sql(p: RuleParams = RuleParams()) -> str:
    """The contract's columns in DuckDB SQL, over ``documents``."""
    stop = ", ".join(f"'{w}'" for w in p.stop_words)
    rules = " AND ".join(b for r in p.rules for b in _sql_bounds(r)) or "true"
    blank = r"[\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM documents),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM d, unnest(range(1, len(w) - 1)) AS t(i)),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win),
cov AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM rep, unnest(range(3)) AS t(j) WHERE c > 1 GROUP BY rid),
m AS (SELECT d.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{blank}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
  len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{{L}}'))) AS n_unlettered, len(list_filter(w, lambda x: regexp_matches(x, '(!!|\?\?)$'))) AS n_shouted,
  len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…){blank}*$'))) AS n_broken_lines, len(list_filter(lines, lambda x: regexp_matches(x, '^{blank}*[-*•]{blank}'))) AS n_listed_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN cov ON cov.rid = d.rid),
b AS (SELECT *, n_words < {p.least_words} OR 100 * n_repeat_words > {p.most_repeated} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules} AS kept FROM b
"""
