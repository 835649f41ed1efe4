"""Concentration and authorship queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import authorship as A
from ..operators import concentration as C
from .facts import AP, FAP, LOOK_BACK, PERIODS, author_papers, field_author_papers, field_papers, papers, parts
from .registry import query

PCTS = [1, 5, 10]


def _credited(spark: SparkSession, sf_dir: str) -> DataFrame:
    ap = author_papers(spark, sf_dir)
    return ap.select(F.col("author").alias("author_id"), F.col("paper").alias("publication_id"), "y", F.count("*").over(Window.partitionBy("paper")).alias("n_authors"))


CRED = f"WITH {AP}, cr AS (SELECT author AS author_id, paper AS publication_id, y, count(*) OVER (PARTITION BY paper) AS n_authors FROM ap)"
PROD = "SELECT {by} author_id, {credit} AS publication_credit, count(publication_id) AS publication_rows, count(DISTINCT publication_id) AS distinct_publications FROM cr GROUP BY {by} author_id"


@query(f"{CRED} " + PROD.format(by="", credit="round(sum(1.0::DOUBLE / n_authors), 9)"))
def author_productivity_fractional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.productivity(_credited(spark, sf_dir)).withColumn("publication_credit", F.round("publication_credit", 9))


@query(f"{CRED} " + PROD.format(by="", credit="sum(1.0::DOUBLE)"))
def author_productivity_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.productivity(_credited(spark, sf_dir), "full")


SUMMARY = """, prod AS (""" + PROD.format(by="{by}", credit="sum(1.0::DOUBLE / n_authors)") + """),
rk AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY publication_credit DESC, author_id) AS d,
  row_number() OVER (PARTITION BY {part} ORDER BY publication_credit, author_id) AS a,
  count(*) OVER (PARTITION BY {part}) AS n, sum(publication_credit) OVER (PARTITION BY {part}) AS t FROM prod)
SELECT {by} count(*) AS n_authors, round(sum(publication_credit), 6) AS total_credit,
  round(sum(publication_credit) FILTER (d <= greatest(1, floor(n * 0.01::DOUBLE))) / max(t), 6) AS top_1pct_share,
  round(sum(publication_credit) FILTER (d <= greatest(1, floor(n * 0.05::DOUBLE))) / max(t), 6) AS top_5pct_share,
  round(sum(publication_credit) FILTER (d <= greatest(1, floor(n * 0.1::DOUBLE))) / max(t), 6) AS top_10pct_share,
  round(sum(power(publication_credit / t, 2)), 9) AS hhi,
  round(2 * sum(a * publication_credit) / (max(n) * max(t)) - (max(n) + 1) / max(n), 6) AS gini
FROM rk {group}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9 if c == "hhi" else 6) for c in ("total_credit", "top_1pct_share", "top_5pct_share", "top_10pct_share", "hhi", "gini")})


@query(CRED + SUMMARY.format(by="", part="1", group=""))
def concentration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.summary(C.productivity(_credited(spark, sf_dir))))


@query(CRED + SUMMARY.format(by="y,", part="y", group="GROUP BY y"))
def concentration_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.summary(C.productivity(_credited(spark, sf_dir), by=("y",)), by=("y",)))


def _rolling_sql(scope: str, facts: str, totals: str, pcts: str) -> str:
    s, using = (f"{scope}, ", f"USING ({scope}, y") if scope else ("", "USING (y")
    return f"""
yrs AS (SELECT DISTINCT y FROM {facts}),
cnt AS (SELECT {s} yrs.y, author, count(DISTINCT paper) AS c FROM yrs JOIN {facts} f ON f.y BETWEEN yrs.y - {LOOK_BACK} AND yrs.y - 1 GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY {s} y ORDER BY c DESC) AS rn, count(*) OVER (PARTITION BY {s} y) AS n FROM cnt),
cut AS (SELECT {s} y, p, n, c AS cutoff FROM rk, (VALUES {pcts}) v(p) WHERE rn = greatest(1, ceil(n * p / 100.0::DOUBLE))),
sel AS (SELECT {s} y, p, n, cutoff, author, c FROM cut JOIN cnt {using}) WHERE c >= cutoff),
size AS (SELECT {s} y, p, max(n) AS n, max(cutoff) AS cutoff, count(*) AS m FROM sel GROUP BY ALL),
hit AS (SELECT {s} y, p, count(DISTINCT paper) AS h FROM sel JOIN {facts} f {using}, author) GROUP BY ALL),
tot AS (SELECT {s} y, count(DISTINCT paper) AS total FROM {totals} GROUP BY ALL)
SELECT {s} y, p, coalesce(n, 0) AS eligible_authors, coalesce(m, 0) AS selected_authors, cutoff AS cutoff_papers,
  coalesce(h, 0) AS papers_with_top, total AS total_papers, round(coalesce(h, 0) / total, 6) AS share
FROM tot CROSS JOIN (VALUES {pcts}) v(p) LEFT JOIN size {using}, p) LEFT JOIN hit {using}, p)"""


@query(f"WITH {AP}," + _rolling_sql("", "ap", "papers", "(1), (5), (10)"))
def rolling_top_author_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rolling_top_shares(papers(spark, sf_dir), author_papers(spark, sf_dir), LOOK_BACK, PCTS)


def _field_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rolling_top_shares(None, field_author_papers(spark, sf_dir), LOOK_BACK, [10], ("field",))


FIELD_TOP = f"WITH {FAP}," + _rolling_sql("field", "fap", "fap", "(10)")


@query(FIELD_TOP)
def field_year_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _field_top(spark, sf_dir)


@query(
    f"""WITH annual AS ({FIELD_TOP}), s AS (SELECT field,
  sum(papers_with_top) FILTER (y BETWEEN 1996 AND 1998) / sum(total_papers) FILTER (y BETWEEN 1996 AND 1998) AS share_early,
  sum(papers_with_top) FILTER (y BETWEEN 1999 AND 2001) / sum(total_papers) FILTER (y BETWEEN 1999 AND 2001) AS share_late
  FROM annual WHERE y BETWEEN 1996 AND 2001 GROUP BY field)
SELECT field, round(share_early, 9) AS share_early, round(share_late, 9) AS share_late, round((share_late - share_early) * 100, 7) AS change_points,
  CAST(rank() OVER (ORDER BY share_late DESC NULLS LAST) AS INTEGER) AS place FROM s"""
)
def field_period_share_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.period_shares(_field_top(spark, sf_dir), PERIODS)
    return out.withColumns({"share_early": F.round("share_early", 9), "share_late": F.round("share_late", 9), "change_points": F.round("change_points", 7)})


@query(
    f"""WITH {AP}, cnt AS (SELECT author, count(DISTINCT paper) AS c FROM ap WHERE y BETWEEN 1998 AND 2000 GROUP BY author),
rk AS (SELECT *, row_number() OVER (ORDER BY c DESC) AS rn, count(*) OVER () AS n FROM cnt),
cut AS (SELECT c AS cutoff FROM rk WHERE rn = greatest(1, ceil(n * 5 / 100.0::DOUBLE)))
SELECT author, p_name AS name, c AS papers, CAST(row_number() OVER (ORDER BY c DESC, author) AS INTEGER) AS place
FROM cnt JOIN cut ON c >= cutoff JOIN part ON p_partkey = author"""
)
def rolling_top_author_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The authors above the 5 % cutoff for the year 2001, with names; ties included."""
    counts = A.history_counts(author_papers(spark, sf_dir), LOOK_BACK).where("y = 2001")
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("author"), F.col("p_name").alias("name"))
    out = A.top_authors(counts, [5]).join(names, "author")
    return out.select("author", "name", F.col("c").alias("papers"), F.row_number().over(Window.orderBy(F.desc("c"), "author")).alias("place"))


@query(
    f"""WITH {AP}, f AS (SELECT *, min(y) OVER (PARTITION BY author) AS fy FROM ap),
a AS (SELECT y, count(DISTINCT author) AS authors, count(DISTINCT author) FILTER (y = fy) AS new_authors, count(DISTINCT paper) FILTER (y = fy) AS papers_with_new FROM f GROUP BY y),
t AS (SELECT y, count(DISTINCT paper) AS total_papers FROM papers GROUP BY y)
SELECT y, total_papers, coalesce(authors, 0) AS authors, coalesce(new_authors, 0) AS new_authors, coalesce(papers_with_new, 0) AS papers_with_new,
  round(new_authors / nullif(authors, 0), 6) AS new_author_share, round(coalesce(papers_with_new, 0) / total_papers, 6) AS new_paper_share FROM t LEFT JOIN a USING (y)"""
)
def new_author_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.new_author_stats(papers(spark, sf_dir), author_papers(spark, sf_dir))


PERIOD_SQL = "CASE WHEN {y} BETWEEN 1996 AND 1998 THEN 'early' WHEN {y} BETWEEN 1999 AND 2001 THEN 'late' ELSE '' END"


@query(
    f"""WITH {FAP}, f AS (SELECT *, min(y) OVER (PARTITION BY field, author) AS fy FROM fap),
g AS (SELECT *, {PERIOD_SQL.format(y="y")} AS period, {PERIOD_SQL.format(y="fy")} AS fp FROM f)
SELECT field, period, count(DISTINCT author) AS authors, count(DISTINCT author) FILTER (period = fp) AS new_authors,
  round(count(DISTINCT author) FILTER (period = fp) / count(DISTINCT author), 6) AS new_share FROM g WHERE period <> '' GROUP BY field, period"""
)
def field_new_author_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.new_author_periods(field_author_papers(spark, sf_dir), PERIODS, ("field",))


def _entry_sql(facts: str, scope: str) -> str:
    s = f"{scope}, " if scope else ""
    on = f"b.{scope} = a.{scope} AND " if scope else ""
    sel = f"a.{scope}, " if scope else ""
    return f"""
f AS (SELECT *, min(y) OVER (PARTITION BY {s} author) AS fy FROM {facts}),
d AS (SELECT {sel} a.author, max(a.fy) AS entry_year, count(DISTINCT a.paper) AS first_year_papers,
  CAST(coalesce(max(CASE WHEN b.author IS NOT NULL THEN 1 ELSE 0 END), 0) AS INTEGER) AS has_coauthor,
  CAST(coalesce(max(CASE WHEN b.fy < a.fy THEN 1 ELSE 0 END), 0) AS INTEGER) AS has_experienced,
  CAST(coalesce(max(CASE WHEN b.fy = a.fy THEN 1 ELSE 0 END), 0) AS INTEGER) AS has_other_new
  FROM f a LEFT JOIN f b ON {on} b.paper = a.paper AND b.author <> a.author WHERE a.y = a.fy GROUP BY {sel} a.author),
e AS (SELECT *, CASE WHEN has_experienced = 1 THEN 'with_experienced_coauthor' WHEN has_other_new = 1 THEN 'only_with_other_new_coauthors' ELSE 'solo' END AS entry_type FROM d)"""


ENTRY_BY = """SELECT {key}, count(*) FILTER (entry_type = 'with_experienced_coauthor') AS with_experienced_coauthor,
  count(*) FILTER (entry_type = 'only_with_other_new_coauthors') AS only_with_other_new_coauthors, count(*) FILTER (entry_type = 'solo') AS solo,
  count(*) AS total_new_authors, round(count(*) FILTER (entry_type = 'with_experienced_coauthor') / count(*), 6) AS share_with_experienced_coauthor,
  round(count(*) FILTER (entry_type = 'only_with_other_new_coauthors') / count(*), 6) AS share_only_with_other_new_coauthors,
  round(count(*) FILTER (entry_type = 'solo') / count(*), 6) AS share_solo FROM e GROUP BY {key}"""


@query(f"WITH {AP}," + _entry_sql("ap", "") + " SELECT * FROM e")
def entry_coauthor_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.entry_types(author_papers(spark, sf_dir), parts=parts(spark, sf_dir))


@query(f"WITH {AP}," + _entry_sql("ap", "") + " " + ENTRY_BY.format(key="entry_year"))
def entry_coauthor_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.entry_types_by(A.entry_types(author_papers(spark, sf_dir), parts=parts(spark, sf_dir)), "entry_year")


@query(
    f"WITH {FAP},"
    + _entry_sql("fap", "field")
    + f""" SELECT field, {PERIOD_SQL.format(y="entry_year")} AS period, entry_type, count(*) AS authors FROM e WHERE entry_year BETWEEN 1996 AND 2001 GROUP BY ALL"""
)
def field_entry_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = A.entry_types(field_author_papers(spark, sf_dir), ("field",), parts(spark, sf_dir)).withColumn("period", A.period_of(F.col("entry_year"), PERIODS))
    return detail.where("period <> ''").groupBy("field", "period", "entry_type").agg(F.count("*").alias("authors"))


GAPS = """
o AS (SELECT *, row_number() OVER w AS rn, lag(y) OVER w AS previous_y, lag(paper) OVER w AS previous_paper, min(y) OVER (PARTITION BY {s} author) AS fy
  FROM {facts} WINDOW w AS (PARTITION BY {s} author ORDER BY y, paper)),
g AS (SELECT {s} author, fy, rn, previous_paper, paper, previous_y, y, y - previous_y AS gap FROM o WHERE rn >= 2)"""


@query(f"WITH {AP}," + GAPS.format(s="", facts="ap") + " SELECT author, fy, CAST(rn AS INTEGER) AS rn, previous_paper, paper, previous_y, y, gap FROM g")
def publication_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.publication_gaps(author_papers(spark, sf_dir))


T_TABLE = ", ".join(f"({df}, {A.t_quantile(df)!r}::DOUBLE)" for df in range(1, A.EXACT_DF + 1))
Z = 1.959963984540054
T_FAR = (
    f"({Z}::DOUBLE + {(Z**3 + Z) / 4!r}::DOUBLE / v + {(5 * Z**5 + 16 * Z**3 + 3 * Z) / 96!r}::DOUBLE / power(v, 2) + "
    f"{(3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z) / 384!r}::DOUBLE / power(v, 3) + {(79 * Z**9 + 776 * Z**7 + 1482 * Z**5 - 1920 * Z**3 - 945 * Z) / 92160!r}::DOUBLE / power(v, 4))"
)
GAP_STATS = """s AS (SELECT {keys}, count(DISTINCT author) AS authors, count(*) AS n_gaps, avg(gap) AS mean_gap, stddev_samp(gap) AS std_gap,
  median(gap)::DOUBLE AS median_gap, avg(CASE WHEN gap = 0 THEN 1 ELSE 0 END) AS share_same_year FROM {src} GROUP BY {keys})"""
ROUND_STATS = "authors, n_gaps, round(mean_gap, 6) AS mean_gap, round(std_gap, 6) AS std_gap, median_gap, round(share_same_year, 6) AS share_same_year"
CI = (
    f", tt(df, t) AS (VALUES {T_TABLE}), c AS (SELECT s.*, CASE WHEN {{n}} > 1 THEN coalesce(t, {T_FAR}) END * std_gap / sqrt({{n}}) AS half "
    "FROM (SELECT *, nullif({n} - 1, 0)::DOUBLE AS v FROM s) s LEFT JOIN tt ON tt.df = {n} - 1) "
)


def _stats(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c in ("mean_gap", "std_gap", "share_same_year", "ci_low", "ci_high")})


COHORT = "CASE WHEN fy BETWEEN 1995 AND 1996 THEN 'early' WHEN fy BETWEEN 1997 AND 1998 THEN 'middle' WHEN fy BETWEEN 1999 AND 2001 THEN 'late' ELSE '' END"
COHORTS = {"early": (1995, 1996), "middle": (1997, 1998), "late": (1999, 2001)}


@query(
    f"WITH {AP},"
    + GAPS.format(s="", facts="ap")
    + f", k AS (SELECT *, {COHORT} AS cohort, CAST(rn AS INTEGER) AS transition FROM g WHERE {COHORT} <> '' AND rn <= 10),"
    + GAP_STATS.format(keys="cohort, transition", src="k")
    + CI.format(n="authors")
    + f"SELECT cohort, transition, {ROUND_STATS}, round(mean_gap - half, 6) AS ci_low, round(mean_gap + half, 6) AS ci_high FROM c"
)
def gap_by_cohort_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = A.publication_gaps(author_papers(spark, sf_dir)).withColumn("cohort", A.period_of(F.col("fy"), COHORTS)).withColumnRenamed("rn", "transition")
    stats = A.gap_summary(gaps.where("cohort <> '' AND transition <= 10"), ["cohort", "transition"])
    return _stats(A.with_confidence(stats, "authors"))


@query(
    f"WITH {AP},"
    + GAPS.format(s="", facts="ap")
    + ", k AS (SELECT *, fy AS entry_year FROM g WHERE rn = 2 AND fy BETWEEN 1995 AND 1999 AND gap <= 5),"
    + GAP_STATS.format(keys="entry_year", src="k")
    + f" SELECT entry_year, {ROUND_STATS} FROM s"
)
def first_second_gap_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = A.publication_gaps(author_papers(spark, sf_dir)).where("rn = 2 AND fy BETWEEN 1995 AND 1999 AND gap <= 5").withColumn("entry_year", F.col("fy"))
    return _stats(A.gap_summary(gaps, ["entry_year"]))


@query(
    f"WITH {FAP},"
    + GAPS.format(s="field,", facts="fap")
    + f", k AS (SELECT *, {PERIOD_SQL.format(y='fy')} AS period FROM g WHERE rn = 2 AND fy BETWEEN 1996 AND 2001),"
    + GAP_STATS.format(keys="field, period", src="k")
    + CI.format(n="n_gaps")
    + f"SELECT field, period, {ROUND_STATS}, round(mean_gap - half, 6) AS ci_low, round(mean_gap + half, 6) AS ci_high FROM c"
)
def field_gap_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = A.publication_gaps(field_author_papers(spark, sf_dir), ("field",)).withColumn("period", A.period_of(F.col("fy"), PERIODS))
    return _stats(A.with_confidence(A.gap_summary(gaps.where("rn = 2 AND period <> ''"), ["field", "period"]), "n_gaps"))


@query(
    f"""WITH {AP}, o AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY y, paper) AS rn FROM ap),
w AS (SELECT author, min(y) FILTER (rn = 1) AS fy, min(y) FILTER (rn = 2) AS sy FROM o WHERE rn <= 2 GROUP BY author), e AS (SELECT min(y) AS lo, max(y) AS hi FROM ap)
SELECT fy AS entry_year, max(lo) AS observation_start, max(hi) AS observation_end, count(*) AS entry_authors, count(*) FILTER (sy - fy BETWEEN 0 AND 2) AS second_within,
  count(*) FILTER (sy - fy > 2) AS second_after, count(*) FILTER (sy IS NULL) AS no_second, count(*) - count(*) FILTER (sy - fy BETWEEN 0 AND 2) AS without_within,
  round(count(*) FILTER (sy - fy BETWEEN 0 AND 2) / count(*), 6) AS probability FROM w, e WHERE fy + 2 <= hi GROUP BY fy"""
)
def second_pub_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.second_publication(author_papers(spark, sf_dir), 2)


@query(f"WITH {AP}, f AS (SELECT *, min(y) OVER (PARTITION BY author) AS fy FROM ap) SELECT paper, author, y, fy FROM f WHERE fy + 3 <= (SELECT max(y) FROM ap) AND y - fy BETWEEN 0 AND 3")
def followup_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.followup(author_papers(spark, sf_dir), 3)


@query(
    f"""WITH {FAP}, c AS (SELECT field, count(DISTINCT paper) AS papers FROM fap GROUP BY field)
SELECT field, papers, CAST(row_number() OVER (ORDER BY papers DESC, field) AS INTEGER) AS place, round(papers / sum(papers) OVER (), 4) AS share FROM c"""
)
def field_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.field_ranking(field_papers(spark, sf_dir))


TREND = f"""WITH {FAP}, c AS (SELECT field, y, count(DISTINCT paper) AS papers FROM fap GROUP BY field, y), t AS (SELECT y, count(DISTINCT paper) AS year_papers FROM fap GROUP BY y),
sp AS (SELECT field, CAST(y AS INTEGER) AS y FROM (SELECT DISTINCT field FROM fap), (SELECT unnest(range(min(y), max(y) + 1)) AS y FROM fap))
SELECT field, y, coalesce(papers, 0) AS papers, coalesce(year_papers, 0) AS year_papers, round(coalesce(papers / nullif(year_papers, 0), 0), 6) AS share FROM sp LEFT JOIN c USING (field, y) LEFT JOIN t USING (y)"""


@query(TREND)
def field_year_trend_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dense_trend(field_papers(spark, sf_dir))


@query(
    f"""WITH tr AS ({TREND}) SELECT *, round(share - lag(share) OVER (PARTITION BY field ORDER BY y), 6) AS share_change FROM tr WHERE y BETWEEN 1996 AND 2000"""
)
def field_year_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart-ready shares of the middle years with their change."""
    rows = A.dense_trend(field_papers(spark, sf_dir)).where("y BETWEEN 1996 AND 2000")
    return rows.withColumn("share_change", F.round(F.col("share") - F.lag("share").over(Window.partitionBy("field").orderBy("y")), 6))
