"""Authorship statistics over ``(paper, author, y)`` facts.

``papers(paper, y)`` has one row for each paper, ``author_papers(paper, author, y)`` one for each
author of a paper.  ``by`` names further key columns (a field, say) that scope every statistic.
"""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import spread
from ..functions.scratch import Scratch


def first_year(by: tuple[str, ...] = ()) -> Column:
    """First year of the author in the scope, on every row."""
    return F.min("y").over(Window.partitionBy(*by, "author"))


def history_counts(author_papers: DataFrame, look_back: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Papers of each author in the ``look_back`` years before each year.

    ``author_papers`` has a paper's author once, so papers are counted per year first; only these
    counts are dealt to the years after them: an explode and one sum, not a range join.
    """
    years = author_papers.groupBy(*by, "author", "y").agg(F.count("*").alias("n"))
    ends = author_papers.agg(F.max("y").alias("hi"))
    counted = years.crossJoin(F.broadcast(ends)).where("y < hi")  # one row
    counted = counted.select(*by, "author", "n", F.explode(F.sequence(F.col("y") + 1, F.least(F.col("y") + look_back, F.col("hi")))).alias("y"))
    return counted.groupBy(*by, "y", "author").agg(F.sum("n").alias("c"))


def cutoffs(counts: DataFrame, percents: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """By key and percent: all authors ``n``, position ``nominal = max(1, ceil(n p / 100))``, the count there, and how many reach it.

    The position is found on (count, number of authors) rows, so no ranking of all authors is needed.
    """
    key = [*by, "y"]
    kinds = counts.groupBy(*key, "c").agg(F.count("*").alias("k"))
    whole = Window.partitionBy(*key)
    run = whole.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kinds = kinds.withColumns({"n": F.sum("k").over(whole), "upto": F.sum("k").over(run)})
    kinds = kinds.select("*", F.explode(F.array(*[F.lit(p) for p in percents])).alias("p"))
    nominal = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("p") / F.lit(100.0)))
    reached = kinds.withColumn("nominal", nominal.cast("long")).where(F.col("upto") >= F.col("nominal"))
    return reached.groupBy(*key, "p", "n", "nominal").agg(F.max("c").alias("cutoff"), F.min("upto").alias("selected"))


def top_authors(counts: DataFrame, percents: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """Authors at or above the :func:`cutoffs`, ties included."""
    key = [*by, "y"]
    met = counts.join(cutoffs(counts, percents, by), key).where(F.col("c") >= F.col("cutoff"))
    return met.select(*key, "p", "n", "nominal", "cutoff", "author", "c")


def rolling_top_shares(papers: DataFrame | None, author_papers: DataFrame, look_back: int, percents: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """Share of each year's papers that have an author from the top of the years before; a dense spine of years.

    Without ``papers`` the papers that have an author are counted.  The facts and the authors' counts are
    written once and read by each step that needs them.
    """
    with Scratch(author_papers.sparkSession, "top-shares") as scratch:
        facts = scratch.write(author_papers.select(*by, "paper", "author", "y"))
        counts = scratch.write(history_counts(facts, look_back, by))
        cuts = scratch.write(cutoffs(counts, percents, by))
        # An author of a top percent is one of every larger percent, so each has one row with the least, and so has a paper.
        steps = cuts.groupBy(*by, "y").agg(F.collect_list(F.struct("p", "cutoff")).alias("steps"))
        least = F.array_min(F.transform(F.filter("steps", lambda x: F.col("c") >= x["cutoff"]), lambda x: x["p"]))
        chosen = counts.join(steps, [*by, "y"]).select(*by, "y", "author", least.alias("least")).where("least IS NOT NULL")
        reached = facts.join(chosen, [*by, "y", "author"]).groupBy(*by, "y", "paper").agg(F.min("least").alias("least")).groupBy(*by, "y", "least").agg(F.count("*").alias("n"))
        every = F.filter(F.array(*[F.lit(p) for p in percents]), lambda p: p >= F.col("least"))
        hits = reached.select(*by, "y", F.explode(every).alias("p"), "n").groupBy(*by, "y", "p").agg(F.sum("n").alias("papers_with_top"))
        totals = (facts if papers is None else papers).groupBy(*by, "y").agg(F.countDistinct("paper").alias("total_papers"))
        spine = totals.select("*", F.explode(F.array(*[F.lit(p) for p in percents])).alias("p"))
        sizes = cuts.select(*by, "y", "p", F.col("n").alias("eligible_authors"), F.col("selected").alias("selected_authors"), F.col("cutoff").alias("cutoff_papers"))
        out = spine.join(sizes, [*by, "y", "p"], "left").join(hits, [*by, "y", "p"], "left").na.fill(0, ["eligible_authors", "selected_authors", "papers_with_top"])
        share = F.round(F.col("papers_with_top") / F.col("total_papers"), 6)
        return scratch.kept(out.select(*by, "y", "p", "eligible_authors", "selected_authors", "cutoff_papers", "papers_with_top", "total_papers", share.alias("share")))


def new_author_stats(papers: DataFrame, author_papers: DataFrame) -> DataFrame:
    """New and all authors, and papers with a new author, by year."""
    marked = author_papers.withColumn("new", F.col("y") == first_year())
    authors = marked.groupBy("y").agg(F.countDistinct("author").alias("authors"), F.countDistinct(F.when(F.col("new"), F.col("author"))).alias("new_authors"), F.countDistinct(F.when(F.col("new"), F.col("paper"))).alias("papers_with_new"))
    totals = papers.groupBy("y").agg(F.countDistinct("paper").alias("total_papers"))
    out = totals.join(authors, "y", "left").na.fill(0)
    return out.select("*", F.round(F.try_divide("new_authors", "authors"), 6).alias("new_author_share"), F.round(F.try_divide("papers_with_new", "total_papers"), 6).alias("new_paper_share"))


def new_author_periods(author_papers: DataFrame, periods: dict[str, tuple[int, int]], by: tuple[str, ...]) -> DataFrame:
    """Authors of each period, and those whose first year in the scope lies in it."""
    marked = author_papers.withColumn("fy", first_year(by))
    rows = marked.select("*", period_of(F.col("y"), periods).alias("period"), period_of(F.col("fy"), periods).alias("first_period")).where("period <> ''")
    out = rows.groupBy(*by, "period").agg(F.countDistinct("author").alias("authors"), F.countDistinct(F.when(F.col("period") == F.col("first_period"), F.col("author"))).alias("new_authors"))
    return out.withColumn("new_share", F.round(F.col("new_authors") / F.col("authors"), 6))


def period_of(year: Column, periods: dict[str, tuple[int, int]]) -> Column:
    """The label of the range that holds the year; blank if none."""
    out = F.lit("")
    for label, (lo, hi) in periods.items():
        out = F.when(year.between(lo, hi), label).otherwise(out)
    return out


EXPERIENCED, NEWCOMERS, SOLO = "with_experienced_coauthor", "only_with_other_new_coauthors", "solo"


def entry_types(author_papers: DataFrame, by: tuple[str, ...] = (), parts: int = 0) -> DataFrame:
    """Each author's kind of first-year coauthors: experienced, else other newcomers, else none.

    A coauthor is experienced if some author of the paper started before the paper's year; that is
    a window minimum per paper, and the number of authors tells solo papers, so no self-join of
    authors is needed.  Windows hold a partition's rows: ``parts`` is how many they are dealt to,
    0 as many as Spark finds best.
    """
    paper = Window.partitionBy(*by, "paper")
    marked = spread(author_papers, parts, *by, "author").dropDuplicates([*by, "paper", "author"]).withColumn("fy", first_year(by))
    marked = spread(marked, parts, *by, "paper").withColumns({"oldest": F.min("fy").over(paper), "size": F.count("*").over(paper), "starters": F.count_if(F.col("fy") == F.col("y")).over(paper)}).where(F.col("y") == F.col("fy"))
    out = marked.groupBy(*by, "author").agg(
        F.first("fy").alias("entry_year"),
        F.countDistinct("paper").alias("first_year_papers"),
        F.max((F.col("size") > 1).cast("int")).alias("has_coauthor"),
        F.max((F.col("oldest") < F.col("y")).cast("int")).alias("has_experienced"),
        F.max((F.col("starters") > 1).cast("int")).alias("has_other_new"),
    )
    kind = F.when(F.col("has_experienced") == 1, EXPERIENCED).when(F.col("has_other_new") == 1, NEWCOMERS).otherwise(SOLO)
    return out.withColumn("entry_type", kind)


def entry_types_by(detail: DataFrame, key: str) -> DataFrame:
    """Counts and shares of the entry types for each value of ``key``."""
    kinds = [EXPERIENCED, NEWCOMERS, SOLO]
    out = detail.groupBy(key).pivot("entry_type", kinds).agg(F.countDistinct("author")).na.fill(0, kinds)
    out = out.withColumn("total_new_authors", sum((F.col(k) for k in kinds[1:]), F.col(kinds[0])))
    return out.withColumns({f"share_{k}": F.round(F.col(k) / F.col("total_new_authors"), 6) for k in kinds})


def sequence_number(by: tuple[str, ...] = ()) -> Column:
    """Number of the author's paper in the order of (year, paper)."""
    return F.row_number().over(Window.partitionBy(*by, "author").orderBy("y", "paper"))


def publication_gaps(author_papers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Consecutive publications of each author: number, years, gap, and first year."""
    order = Window.partitionBy(*by, "author").orderBy("y", "paper")
    rows = author_papers.withColumns({"rn": sequence_number(by), "previous_y": F.lag("y").over(order), "previous_paper": F.lag("paper").over(order), "fy": first_year(by)})
    return rows.where("rn >= 2").select(*by, "author", "fy", "rn", "previous_paper", "paper", "previous_y", "y", (F.col("y") - F.col("previous_y")).alias("gap"))


def gap_summary(gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Authors, mean, sample deviation, median and share of same-year gaps of each group."""
    gap = F.col("gap").cast("double")
    return gaps.groupBy(*keys).agg(F.countDistinct("author").alias("authors"), F.count("*").alias("n_gaps"), F.avg(gap).alias("mean_gap"), F.stddev_samp(gap).alias("std_gap"), F.median(gap).alias("median_gap"), F.avg((F.col("gap") == 0).cast("int")).alias("share_same_year"))


@cache
def t_quantile(df: int, p: float = 0.975) -> float:
    """Quantile of Student's t by bisection on its distribution function (finite sums, whole ``df``)."""

    def cdf(t: float) -> float:
        theta = math.atan(t / math.sqrt(df))
        c2 = math.cos(theta) ** 2
        if df % 2:
            term, s = 1.0, 0.0
            for k in range((df - 1) // 2):
                s += term
                term *= c2 * (2 * k + 2) / (2 * k + 3)
            return 0.5 + (theta + math.sin(theta) * math.cos(theta) * s) / math.pi
        term, s = 1.0, 0.0
        for k in range(df // 2):
            s += term
            term *= c2 * (2 * k + 1) / (2 * k + 2)
        return 0.5 + math.sin(theta) * s / 2

    lo, hi = 0.0, 20.0
    while cdf(hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


EXACT_DF = 40


def t_factor(n: Column) -> Column:
    """t(0.975, n - 1): exact up to 40 degrees of freedom, then its expansion in 1 / df (error below 1e-9)."""
    table = F.create_map(*[x for df in range(1, EXACT_DF + 1) for x in (F.lit(df), F.lit(t_quantile(df)))])
    z, v = 1.959963984540054, (n - 1).cast("double")
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    far = F.lit(z) + sum((F.lit(t) / F.pow(v, i) for i, t in enumerate(terms[1:], 2)), F.lit(terms[0]) / v)
    return F.when(n > 1, F.when(n - 1 <= EXACT_DF, table[(n - 1).cast("int")]).otherwise(far))


def with_confidence(df: DataFrame, n: str, mean: str = "mean_gap", std: str = "std_gap") -> DataFrame:
    """95 % confidence limits of a mean; null for one value."""
    half = t_factor(F.col(n)) * F.col(std) / F.sqrt(F.col(n))
    return df.withColumns({"ci_low": F.col(mean) - half, "ci_high": F.col(mean) + half})


def second_publication(author_papers: DataFrame, window: int) -> DataFrame:
    """Probability of a second paper within ``window`` years by entry year; complete windows only."""
    rn = sequence_number()
    firsts = author_papers.withColumn("rn", rn).where("rn <= 2").groupBy("author").agg(F.min(F.when(F.col("rn") == 1, F.col("y"))).alias("fy"), F.min(F.when(F.col("rn") == 2, F.col("y"))).alias("sy"))
    ends = author_papers.agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    rows = firsts.crossJoin(F.broadcast(ends)).where(F.col("fy") + window <= F.col("hi"))  # one row
    gap = F.col("sy") - F.col("fy")
    out = rows.groupBy(F.col("fy").alias("entry_year")).agg(
        F.first("lo").alias("observation_start"),
        F.first("hi").alias("observation_end"),
        F.count("*").alias("entry_authors"),
        F.count_if(gap.between(0, window)).alias("second_within"),
        F.count_if(gap > window).alias("second_after"),
        F.count_if(F.col("sy").isNull()).alias("no_second"),
    )
    return out.withColumns({"without_within": F.col("entry_authors") - F.col("second_within"), "probability": F.round(F.col("second_within") / F.col("entry_authors"), 6)})


def followup(author_papers: DataFrame, window: int) -> DataFrame:
    """Papers in the first ``window`` years of authors whose window is complete."""
    ends = author_papers.agg(F.max("y").alias("hi"))
    rows = author_papers.withColumn("fy", first_year()).crossJoin(F.broadcast(ends))  # one row
    return rows.where((F.col("fy") + window <= F.col("hi")) & (F.col("y") - F.col("fy")).between(0, window)).drop("hi")


def field_ranking(field_papers: DataFrame) -> DataFrame:
    """Distinct papers of each field, its place (ties by name) and share of all."""
    counts = field_papers.groupBy("field").agg(F.countDistinct("paper").alias("papers"))
    place = F.row_number().over(Window.orderBy(F.desc("papers"), "field"))  # one row a field
    return counts.withColumns({"place": place, "share": F.round(F.col("papers") / F.sum("papers").over(Window.partitionBy()), 4)})


def dense_trend(field_papers: DataFrame) -> DataFrame:
    """Papers of every field in every year between the first and the last, 0 where there is none, and the year's share."""
    counts = field_papers.groupBy("field", "y").agg(F.countDistinct("paper").alias("papers"))
    ends = field_papers.agg(F.min("y").alias("lo"), F.max("y").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("y"))
    spine = field_papers.select("field").distinct().crossJoin(F.broadcast(ends))  # fields by years
    totals = field_papers.groupBy("y").agg(F.countDistinct("paper").alias("year_papers"))
    out = spine.join(counts, ["field", "y"], "left").join(totals, "y", "left").na.fill(0, ["papers", "year_papers"])
    return out.withColumn("share", F.round(F.coalesce(F.try_divide("papers", "year_papers"), F.lit(0.0)), 6))


def period_shares(annual: DataFrame, periods: dict[str, tuple[int, int]]) -> DataFrame:
    """Sums of numerators and denominators by period, their ratio, its change in points and rank (ties share the best)."""
    a, b = list(periods)
    rows = annual.withColumn("period", period_of(F.col("y"), periods)).where("period <> ''")

    def ratio(label: str) -> Column:
        own = F.col("period") == label
        return F.try_divide(F.sum(F.when(own, F.col("papers_with_top"))), F.sum(F.when(own, F.col("total_papers"))))

    out = rows.groupBy("field").agg(ratio(a).alias("share_early"), ratio(b).alias("share_late"))
    out = out.withColumn("change_points", (F.col("share_late") - F.col("share_early")) * 100)
    return out.withColumn("place", F.rank().over(Window.orderBy(F.desc_nulls_last("share_late"))))  # one row a field
