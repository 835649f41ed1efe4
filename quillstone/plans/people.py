"""Person name, author identifier and row filter queries; parts stand in for authors, line items for their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as K
from ..functions import people as P
from ..functions import text as T
from ..functions.scratch import Scratch
from ..operators import consolidated as D
from ..operators import crosswalk as X
from ..operators import filters as R
from ..operators import linkage as L
from ..operators.cleaning import SourceRules, clean_source
from ..operators.works import WorkRules, clean_works
from .facts import table
from .registry import query

# Raw names: an initial before or after the name, a suffix, a comma form, or the name as it is.
RAW = """raw AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'A. ' || p_name WHEN 1 THEN p_name || ' B' WHEN 2 THEN p_name || ', Jr.' WHEN 3 THEN replace(p_name, ' ', ', ') ELSE '  ' || p_name || '; x9 ' END AS author FROM part),
cl AS (SELECT p_partkey, trim(regexp_replace(author, '\\s+', ' ', 'g')) AS author FROM raw), tk AS (SELECT *, string_split(author, ' ') AS t FROM cl),
fl AS (SELECT *, trim(replace(replace(t[1], '.', ''), ',', '')) AS f, trim(replace(replace(t[-1], '.', ''), ',', '')) AS l FROM tk)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("p_partkey") % 5, F.col("p_name")
    author = F.when(key == 0, F.concat(F.lit("A. "), name)).when(key == 1, F.concat(name, F.lit(" B"))).when(key == 2, F.concat(name, F.lit(", Jr.")))
    author = author.when(key == 3, F.replace(name, F.lit(" "), F.lit(", "))).otherwise(F.concat(F.lit("  "), name, F.lit("; x9 ")))
    return table(spark, sf_dir, "part").select("p_partkey", author.alias("author"))


@query(
    f"""WITH {RAW} SELECT p_partkey, f AS first, l AS last,
  CASE WHEN length(f) = 1 AND len(t) >= 2 AND length(trim(replace(replace(t[2], '.', ''), ',', ''))) > 1 AND trim(replace(replace(t[2], '.', ''), ',', '')) <> l THEN trim(replace(replace(t[2], '.', ''), ',', '')) ELSE f END AS promoted_first,
  CASE WHEN length(l) = 1 AND len(t) >= 2 AND length(trim(replace(replace(t[-2], '.', ''), ',', ''))) > 1 AND trim(replace(replace(t[-2], '.', ''), ',', '')) <> f THEN trim(replace(replace(t[-2], '.', ''), ',', '')) ELSE l END AS promoted_last,
  trim(regexp_replace(regexp_replace(author, ',\\s*Jr\\.?|\\bJr\\.?', '', 'g'), '\\s+', ' ', 'g')) AS without_junior FROM fl"""
)
def name_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last sequences, initials promoted to the neighbouring token, suffix dropped."""
    author = F.col("author")
    rows = _raw(spark, sf_dir).select("p_partkey", "author", P.name_part(P.first_sequence(author)).alias("first"), P.name_part(P.last_sequence(author)).alias("last"))
    return rows.select("p_partkey", "first", "last", P.promoted_first(author, F.col("first"), F.col("last")).alias("promoted_first"), P.promoted_last(author, F.col("first"), F.col("last")).alias("promoted_last"), P.without_junior(author).alias("without_junior"))


@query(f"WITH {RAW} SELECT p_partkey, trim(regexp_replace(author, '[^A-Za-z]+', ' ', 'g')) AS display, trim(regexp_replace(replace(replace(author, '.', ''), ',', ''), '\\s+', ' ', 'g')) AS part FROM raw")
def name_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("p_partkey", P.display_name(F.col("author")).alias("display"), P.name_part(F.col("author")).alias("part"))


@query(
    """WITH k AS (SELECT n_nationkey, CASE WHEN n_nationkey = 3 AND n_name = 'CANADA' THEN 'keyed' ELSE n_name END AS v FROM nation),
i AS (SELECT n_nationkey, replace(v, 'UNITED', 'ONE') AS v FROM k)
SELECT n_nationkey, CASE v WHEN 'FRANCE' THEN 'France' WHEN 'keyed' THEN 'by key' ELSE v END AS corrected, CASE WHEN n_nationkey = 5 THEN 'patched' ELSE n_name END AS patched FROM i JOIN nation USING (n_nationkey)"""
)
def manual_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections by key, by substring and by whole value; single rows patched by hand."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    fixed = P.corrected(F.col("n_name"), exact={"FRANCE": "France", "keyed": "by key"}, inside={"UNITED": "ONE"}, keyed=(F.col("n_nationkey").cast("string"), {"3": {"CANADA": "keyed"}}))
    out = R.patch(rows.withColumn("patched", F.col("n_name")), "patched", [(F.col("n_nationkey") == 5, "patched")])
    return out.select("n_nationkey", fixed.alias("corrected"), "patched")


@query(
    """WITH d AS (SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'Ph.D. in economics' WHEN 1 THEN 'Dphil' WHEN 2 THEN 'Master of arts' WHEN 3 THEN 'DOCTORATE' WHEN 4 THEN 'Dr. rer. pol.' WHEN 5 THEN 'doctoral student' WHEN 6 THEN 'graph design' ELSE NULL END AS degree FROM supplier)
SELECT s_suppkey, regexp_matches(coalesce(degree, ''), '(?i)(\\bph\\.?\\s*d\\.?\\b|\\bd\\.?\\s*phil\\.?\\b|\\bdoctor(ate|al)\\b|\\bdoctor\\s+of\\s+(philosophy|economics)\\b|\\bdoctorat\\b|\\bdr\\.?\\s*rer\\.?\\s*pol\\.?\\b)') AS doctoral FROM d"""
)
def doctoral_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["Ph.D. in economics", "Dphil", "Master of arts", "DOCTORATE", "Dr. rer. pol.", "doctoral student", "graph design"]
    degree = F.get(F.array(*[F.lit(x) for x in names]), (F.col("s_suppkey") % 8).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", P.is_doctoral(degree).alias("doctoral"))


@query()
def person_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name against the name of the part that follows it (no SQL has the sequence ratio)."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    following = rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("candidate"))
    met = rows.join(following, "p_partkey")
    return P.with_person_similarity(met, P.first_sequence(F.col("p_name")), P.last_sequence(F.col("p_name")), F.col("candidate")).select("p_partkey", "similarity")


@query(
    """SELECT c_custkey, 'given-names:"' || replace(c_name, '"', '\\"') || '" AND family-name:"' || replace(replace('a\\' || c_mktsegment || '"', '\\', '\\\\'), '"', '\\"') || '"' AS query,
  CASE WHEN c_custkey % 2 = 0 THEN '0000-0002-1825-' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || 'X' ELSE '' END AS orcid, trim(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') AS filename,
  trim(regexp_replace(c_name || '  ' || c_mktsegment, '\\s+', ' ', 'g')) AS full_name FROM customer"""
)
def person_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search texts, identifiers and file names of persons."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("see https://orcid.org/0000-0002-1825-"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit("x !"))).otherwise("none 12-34")
    family = F.concat(F.lit("a\\"), "c_mktsegment", F.lit('"'))
    return rows.select("c_custkey", P.orcid_query(F.col("c_name"), family).alias("query"), P.orcid(raw).alias("orcid"), P.safe_filename(F.concat_ws(" / ", "c_name", "c_mktsegment")).alias("filename"), P.full_name(F.col("c_name"), F.concat(F.lit(" "), "c_mktsegment")).alias("full_name"))


# Author rows: line items by their part's name; the group of a name key is its first letter and last name.
ROWS = """ar AS (SELECT l_orderkey * 10 + l_linenumber AS ord, CAST(l_orderkey AS VARCHAR) AS doi_full, split_part(p_name, ' ', 2) AS last, CASE WHEN l_linenumber % 5 = 0 THEN '' WHEN l_linenumber % 3 = 0 THEN substr(p_name, 1, 1) ELSE split_part(p_name, ' ', 1) END AS first FROM lineitem JOIN part ON l_partkey = p_partkey),
ak AS (SELECT *, last || '_' || first AS key, last || '_' || substr(first, 1, 1) AS grp FROM ar),
gk AS (SELECT grp, min(key) AS root, count(DISTINCT key) AS n FROM ak GROUP BY grp), gi AS (SELECT root, 'AFZ' || lpad(CAST(row_number() OVER (ORDER BY root) AS VARCHAR), 6, '0') AS author_id FROM gk),
ids AS (SELECT ak.*, author_id, CASE WHEN n > 1 THEN 'cautious_fuzzy' ELSE 'exact' END AS author_group_method FROM ak JOIN gk USING (grp) JOIN gi USING (root)),
rv AS (SELECT ord, author_id, first, last, key, author_group_method, doi_full, concat_ws('; ', CASE WHEN first = '' THEN 'blank_first_name' END, CASE WHEN last = '' THEN 'blank_last_name' END, CASE WHEN length(first) = 1 THEN 'single_letter_first_name' END,
  CASE WHEN author_group_method = 'cautious_fuzzy' THEN 'cautious_fuzzy_group' END, CASE WHEN k > 1 THEN 'multiple_name_keys_in_author_id' END, CASE WHEN first <> '' AND i > 1 THEN 'same_last_name_and_first_initial_multiple_author_ids' END, CASE WHEN r >= 50 THEN 'common_last_name' END) AS manual_review_reasons
  FROM (SELECT ids.*, k, i, r FROM ids JOIN (SELECT author_id, count(DISTINCT key) AS k FROM ids GROUP BY 1) USING (author_id) JOIN (SELECT last, substr(first, 1, 1) AS s, count(DISTINCT author_id) AS i FROM ids GROUP BY ALL) x ON x.last = ids.last AND x.s = substr(first, 1, 1) JOIN (SELECT last AS l2, count(*) AS r FROM ids GROUP BY 1) ON l2 = ids.last))"""


NAME = ["key", "last", "first"]


def _name_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("p_name", " ")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_linenumber")
    first = F.when(n % 5 == 0, "").when(n % 3 == 0, F.substring("p_name", 1, 1)).otherwise(parts[0])
    rows = lines.select((F.col("l_orderkey") * 10 + n).alias("ord"), F.col("l_orderkey").cast("string").alias("doi_full"), parts[1].alias("last"), first.alias("first"))
    return rows.withColumn("key", F.concat_ws("_", "last", "first"))


def _names(rows: DataFrame) -> DataFrame:
    """Ids and review flags of the distinct names; ``rows``: how many rows have the name."""
    scratch = Scratch(rows.sparkSession, "names")
    names = scratch.kept(X.distinct_names(rows, NAME, "rows"))
    groups = names.select("key", F.concat_ws("_", "last", F.substring("first", 1, 1)).alias("grp")).distinct()
    sizes = groups.groupBy("grp").agg(F.min("key").alias("component"), F.count("*").alias("n")).where("n > 1")
    linked = groups.join(sizes, "grp").select(F.col("key").alias("node"), "component")
    return scratch.kept(X.review_flags(X.assign_ids(names, "key", linked), weight="rows"))


def _author_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author rows with ids and flags, which depend on the name alone: rows meet the distinct names once."""
    rows = _name_rows(spark, sf_dir)
    return X.with_names(rows, _names(rows).drop("rows"), NAME)


@query(f"WITH {ROWS} SELECT author_id, count(*) AS n, count(*) FILTER (manual_review_reasons <> '') AS flagged, count(DISTINCT manual_review_reasons) AS kinds, max(author_group_method) AS method FROM rv GROUP BY 1")
def author_review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _author_rows(spark, sf_dir)
    return rows.groupBy("author_id").agg(F.count("*").alias("n"), F.sum("manual_review_flag").alias("flagged"), F.countDistinct("manual_review_reasons").alias("kinds"), F.max("author_group_method").alias("method"))


@query(
    f"""WITH {ROWS}, o AS (SELECT author_id, list(DISTINCT first) AS fs FROM rv GROUP BY 1),
u AS (SELECT author_id, 'f' AS c, first AS v, min(ord) AS o FROM rv WHERE first <> '' GROUP BY ALL UNION ALL SELECT author_id, 'k', key, min(ord) FROM rv GROUP BY ALL UNION ALL SELECT author_id, 'n', trim(first || ' ' || last), min(ord) FROM rv GROUP BY ALL
  UNION ALL SELECT author_id, 'm', author_group_method, min(ord) FROM rv GROUP BY ALL UNION ALL SELECT author_id, 'r', manual_review_reasons, min(ord) FROM rv WHERE manual_review_reasons <> '' GROUP BY ALL)
SELECT author_id, max_by(last, (length(last), -ord)) AS author_last_clean, max_by(first, (length(first), -ord)) AS author_first_clean, min_by(last, ord) AS author_last_key,
  coalesce((SELECT string_agg(v, '; ' ORDER BY o) FROM u WHERE c = 'f' AND u.author_id = rv.author_id), '') AS author_first_keys, (SELECT string_agg(v, '; ' ORDER BY o) FROM u WHERE c = 'k' AND u.author_id = rv.author_id) AS author_name_keys,
  (SELECT string_agg(v, '; ' ORDER BY o) FROM u WHERE c = 'n' AND u.author_id = rv.author_id) AS all_name_versions, count(*) AS n_author_rows, count(DISTINCT doi_full) AS n_papers,
  (SELECT string_agg(v, '; ' ORDER BY o) FROM u WHERE c = 'm' AND u.author_id = rv.author_id) AS author_group_method, CAST(max(CAST(manual_review_reasons <> '' AS INTEGER)) AS INTEGER) AS manual_review_flag,
  coalesce((SELECT string_agg(v, '; ' ORDER BY o) FROM u WHERE c = 'r' AND u.author_id = rv.author_id), '') AS manual_review_reasons FROM rv GROUP BY author_id"""
)
def author_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _author_rows(spark, sf_dir)
    rows = rows.select("ord", "author_id", "doi_full", "author_group_method", "manual_review_flag", "manual_review_reasons", F.col("last").alias("author_last_clean"), F.col("first").alias("author_first_clean"), F.col("last").alias("author_last_key"), F.col("first").alias("author_first_key"), F.col("key").alias("author_name_key"), P.full_name(F.col("first"), F.col("last")).alias("author_full_clean"))
    return X.crosswalk(rows, "ord")


@query(f"WITH {ROWS} SELECT author_id, final_last_name, final_first_name FROM (SELECT author_id, last AS final_last_name, first AS final_first_name, row_number() OVER (PARTITION BY author_id ORDER BY length(last) + length(first) DESC, last, first) AS rn FROM ids) WHERE rn = 1")
def author_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _author_rows(spark, sf_dir)
    return X.author_list(rows.select("author_id", F.col("last").alias("final_last_name"), F.col("first").alias("final_first_name")))


@query(f"WITH {ROWS} SELECT author_id, doi_full, last, first, key, author_group_method, manual_review_reasons FROM rv WHERE manual_review_reasons <> ''")
def author_review_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _name_rows(spark, sf_dir)
    names = _names(rows)
    flagged = names.where("manual_review_flag = 1").agg(F.sum("rows")).first()[0] or 0
    return X.review_extract(X.with_names(rows, names.drop("rows"), NAME), ["author_id", "doi_full", "last", "first", "key", "author_group_method", "manual_review_reasons"], ["last", "first", "author_id", "doi_full"], flagged)


@query(
    f"""WITH {ROWS} SELECT 'first' AS "column", count(*) FILTER (first <> '') AS nonblank, count(DISTINCT nullif(first, '')) AS distinct_nonblank FROM ar UNION ALL SELECT 'last', count(*) FILTER (last <> ''), count(DISTINCT nullif(last, '')) FROM ar
UNION ALL SELECT 'pairs', count(*), count(*) FILTER (first <> '' OR last <> '') FROM (SELECT DISTINCT first, last FROM ar)"""
)
def name_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank and distinct values of two columns, and of their pairs."""
    rows = _name_rows(spark, sf_dir).select("first", "last")
    pairs = X.pair_counts(rows, "first", "last").select(F.lit("pairs").alias("column"), F.col("pairs").alias("nonblank"), F.col("nonblank_pairs").alias("distinct_nonblank"))
    return X.value_counts(rows, ["first", "last"]).union(pairs)


@query("WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 6 = 0 THEN ' ' ELSE c_phone END AS phone FROM (SELECT c_custkey, c_name, c_mktsegment AS c_phone FROM customer)) SELECT 'name' AS \"column\", count(*) FILTER (trim(name) <> '') AS before, count(*) AS after, count(*) FILTER (trim(name) = '') AS filled FROM n UNION ALL SELECT 'phone', count(*) FILTER (trim(phone) <> ''), count(*) FILTER (trim(phone) <> ''), 0 FROM n")
def fill_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank values before and after a clean-up."""
    before = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 6 == 0, " ").otherwise(F.col("c_mktsegment")).alias("phone"))
    after = before.withColumn("name", F.when(F.col("name") == "", "filled").otherwise(F.col("name")))
    return X.fill_counts(before, after, ["name", "phone"])


@query(
    """WITH g AS (SELECT o_custkey AS author, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderkey AS paper FROM orders), w AS (SELECT *, row_number() OVER o AS n, lag(y) OVER o AS py, lag(paper) OVER o AS pp, min(y) OVER (PARTITION BY author) AS e, count(*) OVER (PARTITION BY author) AS c FROM g WINDOW o AS (PARTITION BY author ORDER BY y, paper))
SELECT author, e AS entry_year, c AS n_publications, CAST(n - 1 AS INTEGER) AS from_number, CAST(n AS INTEGER) AS to_number, CAST(n - 1 AS VARCHAR) || '->' || CAST(n AS VARCHAR) AS transition, pp AS previous_paper, paper, py AS previous_year, y AS year, y - py AS gap_years, CAST(y = py AS INTEGER) AS share_same_year, y - e AS years_since_entry FROM w WHERE n > 1"""
)
def gap_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thirteen columns of consecutive publication gaps."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("author"), F.year("o_orderdate").alias("y"), F.col("o_orderkey").alias("paper"))
    return X.gap_numbers(rows, "author", "y", "paper")


@query(
    """SELECT doc_id, lang, source FROM documents WHERE source IS NOT NULL AND NOT (list_contains(string_split('en;' || source, ';'), 'web') OR source = 'code')
  AND NOT (contains(lower(text), 'password=')) AND NOT (lang = 'de' AND doc_id % 2 = 0) AND NOT upper(substr(lang, 1, 1)) IN ('Y', 'F')"""
)
def cleaning_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List membership, literal phrase, one-source rows without a key, code letters, and blocklists."""
    rows = table(spark, sf_dir, "documents").where("source is not null")
    rows = rows.where(~R.has_any(F.concat(F.lit("en; "), "source"), ["web"]) & ~R.listed({"source": [" CODE "]}))
    rows = rows.where(~R.mentions("PASSWORD=", F.col("text"), F.lit(None).cast("string")))
    rows = rows.withColumn("doi", F.when(F.col("doc_id") % 2 == 0, " ").otherwise("10.1"))
    rows = R.drop_unlinked_without_key(rows, "lang", "de", "doi")
    return R.drop_codes(rows, "lang", ["Y", "F"]).select("doc_id", "lang", "source")


@query("SELECT o_orderkey, 'w' || o_orderkey AS paper FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND year(o_orderdate) >= 1998")
def numbered_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working papers by number pattern and year; unreadable dates go."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.when(key % 3 == 0, "h").otherwise("w"), key.cast("string")).alias("paper"), F.when(key % 5 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))
    return R.numbered_since(rows, "paper", "date", 1998).select("o_orderkey", "paper")


@query(
    """WITH r AS (SELECT p_type AS title, p_partkey, p_retailprice FROM part), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY p_retailprice DESC, p_partkey) AS rn FROM r) WHERE rn = 1)
SELECT l.p_partkey AS left_part, f.p_partkey AS right_part FROM part l LEFT JOIN f ON f.title = CASE WHEN l.p_partkey % 7 = 0 THEN '' ELSE l.p_type END"""
)
def keep_first_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join on a title to the first right row of each title."""
    parts = table(spark, sf_dir, "part")
    left = parts.select(F.col("p_partkey").alias("left_part"), F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_type")).alias("title"))
    right = parts.select(F.col("p_partkey").alias("right_part"), F.col("p_type").alias("title"), "p_retailprice")
    return L.keep_first_join(left, right, "title", [F.desc("p_retailprice"), F.col("right_part")]).select("left_part", "right_part")


@query(
    """WITH a AS (SELECT l_orderkey AS paper, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), '; ' ORDER BY CAST(l_suppkey AS VARCHAR)) AS authors FROM lineitem WHERE l_linenumber < 3 GROUP BY 1), j AS (SELECT l_orderkey AS paper, count(*) AS codes FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT o_orderkey AS paper, o_orderstatus, authors, codes FROM orders LEFT JOIN a ON a.paper = o_orderkey LEFT JOIN j ON j.paper = o_orderkey"""
)
def paper_join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left joins of per-paper summaries, each asserted unique."""
    lines = table(spark, sf_dir, "lineitem")
    authors = lines.where("l_linenumber < 3").groupBy(F.col("l_orderkey").alias("paper")).agg(F.array_join(F.sort_array(F.collect_set(F.col("l_suppkey").cast("string"))), "; ").alias("authors"))
    codes = lines.where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("paper")).agg(F.count("*").alias("codes"))
    return L.join_chain(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper"), "o_orderstatus"), [authors, codes], "paper")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN n_name ELSE c_name END AS title, CASE WHEN c_custkey % 3 = 0 THEN 'works' ELSE 'registry' END AS title_source,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS journal, CASE WHEN c_custkey % 2 = 0 THEN 'registry' ELSE '' END AS journal_source FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def combined_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column of two linked sources, the registry's first."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    rows = rows.select("c_custkey", F.when(key % 3 == 0, " ").otherwise(F.col("c_name")).alias("registry_title"), F.col("n_name").alias("works_title"), F.when(key % 2 == 0, F.col("c_mktsegment")).alias("registry_journal"), F.lit("").alias("works_journal"))
    return L.combined_columns(rows, ["title", "journal"], "registry_", "works_").select("c_custkey", "title", "title_source", "journal", "journal_source")


@query()
def three_pass_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two equality passes, then greedy overlap of last names within an order (no SQL says greedy)."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("doi"), F.split("p_name", " ")[1].alias("last"), F.split("p_name", " ")[0].alias("first"), "l_linenumber")
    left, right = rows.where("l_linenumber % 2 = 0").withColumnRenamed("id", "l_id"), rows.where("l_linenumber % 2 = 1").withColumnRenamed("id", "r_id")
    return L.three_pass_outer(left, right, "doi", ("last", "first"), 0.5)


@query(
    """WITH o AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_custkey END AS left_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END AS right_id FROM orders)
SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS INTEGER) AS domain, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY left_id NULLS LAST, right_id NULLS LAST, o_orderkey) AS INTEGER) AS place,
  CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY left_id NULLS FIRST, o_orderkey DESC) AS INTEGER) AS nulls_first FROM o"""
)
def ordered_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed domain order, outer-join order with missing ids last, and missing values first."""
    from pyspark.sql import Window

    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.when(key % 6 != 0, F.col("o_custkey")).alias("left_id"), F.when(key % 4 != 0, key).alias("right_id"))
    part = Window.partitionBy("o_orderpriority")
    place = F.row_number().over(part.orderBy(*R.outer_order("left_id", "right_id"), "o_orderkey"))
    first = F.row_number().over(part.orderBy(F.asc_nulls_first("left_id"), F.desc("o_orderkey")))
    return rows.select("o_orderkey", R.domain_order(F.col("o_orderpriority"), ["3-MEDIUM", "1-URGENT"]).alias("domain"), place.alias("place"), first.alias("nulls_first"))


@query("SELECT p_partkey, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS rn FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS p_type FROM part)) WHERE rn = 1 OR p_type = ''")
def kept_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_type")).alias("p_type"))
    return R.kept_in_order(rows, "p_type", "p_partkey")


DOI_STAGES = 9


def _ten_stages() -> str:
    keys = [f"CAST(doc_id // 2 % {97 + 2 * i} AS VARCHAR) || source AS d{i}" for i in range(DOI_STAGES)] + ["md5(text) AS d9"]
    sql = f"WITH d AS (SELECT doc_id, {', '.join(keys)} FROM documents), l0 AS (SELECT * FROM d WHERE doc_id % 2 = 0), r0 AS (SELECT * FROM d WHERE doc_id % 2 = 1)"
    for i in range(DOI_STAGES + 1):
        sql += f""", m{i} AS (SELECT a.id AS left_id, b.id AS right_id, 'stage {i}' AS strategy FROM (SELECT d{i} AS k, min(doc_id) AS id FROM l{i} WHERE d{i} <> '' GROUP BY 1 HAVING count(*) = 1) a JOIN (SELECT d{i} AS k, min(doc_id) AS id FROM r{i} WHERE d{i} <> '' GROUP BY 1 HAVING count(*) = 1) b USING (k)),
l{i + 1} AS MATERIALIZED (SELECT * FROM l{i} WHERE doc_id NOT IN (SELECT left_id FROM m{i})), r{i + 1} AS MATERIALIZED (SELECT * FROM r{i} WHERE doc_id NOT IN (SELECT right_id FROM m{i}))"""
    every = " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(DOI_STAGES + 1))
    return f"{sql} {every} UNION ALL SELECT doc_id, NULL, 'left_only' FROM l{DOI_STAGES + 1} UNION ALL SELECT NULL, doc_id, 'right_only' FROM r{DOI_STAGES + 1}"


@query(_ten_stages())
def ten_stage_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine key versions, then the text."""
    half = F.floor(F.col("doc_id") / 2).cast("long")
    keys = [F.concat((half % (97 + 2 * i)).cast("string"), "source").alias(f"d{i}") for i in range(DOI_STAGES)] + [F.md5("text").alias("d9")]
    rows = table(spark, sf_dir, "documents").select("doc_id", *keys)
    left, right = rows.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "left_id"), rows.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "right_id")
    return L.staged_link(left, right, ("left_id", "right_id"), [(f"stage {i}", f"d{i}", f"d{i}") for i in range(DOI_STAGES + 1)])


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'B2; C3' ELSE 'C3' END ELSE '' END = 'B2; C3' AS has FROM part")
def predicted_in_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    codes = F.when(key % 3 == 0, F.when(key % 2 == 0, "B2; C3").otherwise("C3")).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", T.has_code(codes, F.lit(" B2 ")).alias("has"))


_PHRASES = ", ".join("'" + x.replace("'", "''") + "'" for x in T.NOT_PAPERS)


@query(
    f"""WITH p AS (SELECT [{_PHRASES}] AS ph), t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'On ' || upper(ph[o_orderkey % len(ph) + 1]) || ' again' ELSE 'Plain title ' || o_orderkey END AS title FROM orders, p)
SELECT o_orderkey, title FROM t, p WHERE len(list_filter(ph, lambda x: contains(lower(title), lower(x)))) = 0"""
)
def not_paper_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without any of the phrases that mark something other than a paper."""
    key, phrases = F.col("o_orderkey"), F.array(*[F.lit(x) for x in T.NOT_PAPERS])
    title = F.when(key % 3 == 0, F.concat(F.lit("On "), F.upper(F.get(phrases, (key % len(T.NOT_PAPERS)).cast("int"))), F.lit(" again"))).otherwise(F.concat(F.lit("Plain title "), key.cast("string")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", title.alias("title"))
    return rows.where(~T.is_not_paper(F.col("title")))


@query(
    """SELECT n_nationkey AS x_n_nationkey, n_name AS x_n_name, '' AS x_extra, CASE n_name WHEN 'FRANCE' THEN 'FR' WHEN 'PERU' THEN 'PE' ELSE n_name END AS mapped, trim(n_name || ' ' || CASE WHEN n_regionkey = 1 THEN '' ELSE CAST(n_regionkey AS VARCHAR) END) AS combined,
  CASE WHEN n_regionkey = 1 THEN n_name ELSE n_name || '; ' || CAST(n_regionkey AS VARCHAR) END AS joined FROM nation"""
)
def column_plumbing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict, padded and tolerant projections, prefixes, order, mapping, combined and joined cells."""
    nation = table(spark, sf_dir, "nation")
    region = F.when(F.col("n_regionkey") == 1, " ").otherwise(F.col("n_regionkey").cast("string"))
    rows = nation.select("*", region.alias("region"))
    made = rows.select("n_nationkey", K.map_values(F.col("n_name"), {"FRANCE": "FR", "PERU": "PE"}).alias("mapped"), K.combine_text(F.col("n_name"), F.col("region")).alias("combined"), K.join_distinct([F.array("n_name", "region"), F.array("n_name")]).alias("joined"))
    plain = K.pad_columns(K.drop_columns(K.keep_columns(nation, ["n_name", "n_nationkey", "n_regionkey"]), ["n_regionkey", "absent"]), ["n_name", "extra", "n_nationkey"])
    plain = K.order_columns(K.add_prefix(K.add_prefix(plain, "x_"), "x_"), ["x_n_nationkey", "absent", "x_extra"])
    return plain.join(made, F.col("x_n_nationkey") == F.col("n_nationkey")).select(*plain.columns, "mapped", "combined", "joined")


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a ' || c_mktsegment WHEN 2 THEN '' ELSE c_mktsegment END AS markup, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || ' x' END AS title,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ' ' || c_name ELSE c_name END AS reversed, c_mktsegment || ' ' || c_name AS versions, round(1 / (1 + exp(1.0::DOUBLE - 2.0::DOUBLE * (c_custkey % 2))), 9) AS soft FROM customer"""
)
def text_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup and null marks, title suffixes, comma names, white space of name versions, softmax."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    markup = F.when(key % 4 == 0, "<i>NULL</i>").when(key % 4 == 1, F.concat(F.lit("<p>a</p> "), "c_mktsegment")).when(key % 4 == 2, r" \N ").otherwise(F.concat(F.lit(" <b>"), "c_mktsegment", F.lit("</b>")))
    title = F.when(key % 3 == 0, F.concat("c_name", F.lit("  Open Access"))).otherwise(F.concat("c_name", F.lit(" x Available for Purchase")))
    comma = F.when(key % 2 == 0, F.concat("c_name", F.lit(" , "), "c_mktsegment")).otherwise(F.col("c_name"))
    versions = F.concat(F.lit(" "), "c_mktsegment", F.lit("\r\n\t "), "c_name")
    soft = F.get(T.softmax(F.array(F.lit(1.0), 2.0 * (key % 2).cast("double"))), 1)
    return rows.select("c_custkey", T.clean_markup(markup).alias("markup"), T.clean_title(title).alias("title"), T.reverse_comma(comma).alias("reversed"), P.name_versions(versions).alias("versions"), F.round(soft, 9).alias("soft"))


@query(
    """WITH s AS (SELECT o_orderkey, 'https://doi.org/10.1/' || (o_orderkey % 400) AS doi, 'T ' || (o_orderkey % 300) AS title, o_orderpriority AS abstract, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_clerk END AS authors, o_orderstatus AS journal, year(o_orderdate) AS y FROM (SELECT *, CAST(o_custkey AS VARCHAR) AS o_clerk FROM orders)),
f AS (SELECT *, lower(title) AS title_key FROM s WHERE journal IN ('F', 'O') AND y BETWEEN 1993 AND 1999 AND NOT contains(lower(title), 't 7') AND o_orderkey NOT IN (5, 6)),
l AS (SELECT * EXCLUDE abstract, first_value(abstract) OVER (PARTITION BY title_key ORDER BY length(abstract) DESC, o_orderkey) AS abstract, count(*) OVER (PARTITION BY title_key) AS n FROM f),
d AS (SELECT * FROM l WHERE NOT (n > 1 AND authors = ''))
SELECT o_orderkey, replace(doi, 'https://doi.org/', '') AS doi, title_key, abstract, authors FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY o_orderkey) AS rn FROM d) WHERE rn = 1"""
)
def source_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cleaning steps of one source in their order."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit(" https://doi.org/10.1/"), (key % 400).cast("string")).alias("doi"), F.concat(F.lit("T  "), (key % 300).cast("string"), F.lit(" *")).alias("title"), F.concat(F.lit("<p>"), "o_orderpriority", F.lit("</p>")).alias("abstract"), F.when(key % 5 == 0, " ").otherwise(F.col("o_custkey").cast("string")).alias("authors"), F.concat(F.lit(" "), "o_orderstatus").alias("journal"), F.year("o_orderdate").alias("year"))
    rules = SourceRules(journals=("f", "o"), years=(1993, 1999), dropped={"o_orderkey": [5, 6]}, phrases=("T  7",))
    return clean_source(rows, rules, "o_orderkey").select("o_orderkey", "doi", "title_key", "abstract", "authors")


SOURCES = """s AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS a_last, upper(c_name) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' x' END AS b_last,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS a_first, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 's' END END AS b_first FROM customer)"""


def _two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name, part = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    a_last = F.when(k % 4 == 0, "").otherwise(name)
    b_first = F.when(k % 7 == 0, " ").otherwise(F.concat(F.lower(part), F.when(k % 2 == 0, "").otherwise("s")))
    return table(spark, sf_dir, "customer").select(k, a_last.alias("a_last"), F.concat(F.upper(name), F.when(k % 3 == 0, "").otherwise(" x")).alias("b_last"), F.when(k % 5 != 0, part).alias("a_first"), b_first.alias("b_first"))


@query(
    f"""WITH {SOURCES} SELECT c_custkey, coalesce(nullif(trim(a_last), ''), trim(b_last)) AS last_name,
  CASE WHEN length(trim(coalesce(a_first, ''))) >= length(trim(b_first)) THEN trim(coalesce(a_first, '')) ELSE trim(b_first) END AS first_name,
  CASE WHEN trim(a_last) = '' THEN trim(b_last) WHEN lower(trim(a_last)) = lower(trim(b_last)) THEN trim(a_last) ELSE trim(a_last) || ';' || trim(b_last) END AS names FROM s"""
)
def consolidated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of two sources as columns of one."""
    plan = {"last_name": ("first", ["a_last", "b_last"]), "first_name": ("longest", ["a_first", "b_first"]), "names": ("joined", ["a_last", "b_last"])}
    return D.consolidated_names(_two_sources(spark, sf_dir), plan, ["c_custkey", *plan])


@query(f"WITH {SOURCES} SELECT c_custkey, CASE WHEN trim(a_last) = '' THEN b_last ELSE a_last END AS a_last, CASE WHEN coalesce(trim(a_first), '') = '' AND trim(b_first) <> '' THEN b_first ELSE a_first END AS a_first FROM s")
def filled_in_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank cells filled from another source; the counters come with the run."""
    return D.fill_in_run(_two_sources(spark, sf_dir), {"a_last": "b_last", "a_first": "b_first"}, ("b_last", "b_first", "absent"))[0]


@query(
    """WITH v AS (SELECT DISTINCT o_orderkey, v FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS v FROM orders UNION ALL SELECT o_orderkey, CAST(o_custkey * 7 AS VARCHAR) FROM orders) WHERE v <> ''),
d AS (SELECT v FROM v GROUP BY v HAVING count(*) > 1) SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM v JOIN d USING (v)) THEN 1 ELSE 0 END AS tag FROM orders"""
)
def shared_value_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders one of whose two identifiers another order has, too."""
    first = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_custkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.array(first, (F.col("o_custkey") * 7).cast("string")).alias("ids"))
    return D.shared_value_tag(rows, "o_orderkey", F.col("ids"), "tag").select("o_orderkey", "tag")


WORKS = r"""WITH w AS (SELECT o_orderkey AS k, 'Title ' || (o_orderkey % 3000) AS title, 'https://doi.org/10.1/' || (o_custkey % 4) AS doi, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'A' || o_custkey END AS authors,
  repeat('x', CAST(o_custkey % 7 AS INTEGER)) || o_orderstatus AS inst, 'Abstract of ' || repeat('y', CAST(o_custkey % 6 AS INTEGER)) AS abstract, 'k' || (o_custkey % 5) AS kw, year(o_orderdate) AS y FROM orders WHERE o_orderkey % 11 <> 3),
g AS (SELECT title, count(*) AS n FROM w GROUP BY 1), u AS (SELECT w.*, n FROM w JOIN g USING (title) WHERE n = 1 OR authors <> '')
SELECT title AS works_title, CAST(n > 1 AS INTEGER) AS works_tag, min_by(authors, k) AS works_authors, CAST(min_by(y, k) AS VARCHAR) AS works_publication_year, max_by(inst, [length(inst), -k]) AS works_author_institutions, trim(max_by(abstract, [length(trim(abstract)), -k])) AS works_abstract,
  array_to_string(list_transform(list_sort(list_transform(map_entries(map(list_distinct(list(kw)), list_transform(list_distinct(list(kw)), lambda v: list_min(list_transform(list_filter(list({'k': k, 'v': kw}), lambda e: e.v = v), lambda e: e.k))))), lambda m: {'k': m.value, 'v': m.key})), lambda m: m.v || ' (0.500)'), '; ') AS works_keywords,
  list_sort(list_transform(map_entries(map(list_distinct(list(doi)), list_transform(list_distinct(list(doi)), lambda v: list_min(list_transform(list_filter(list({'k': k, 'v': doi}), lambda e: e.v = v), lambda e: e.k))))), lambda m: {'k': m.value, 'v': m.key}))[1].v[17:] AS works_doi_1
FROM u GROUP BY title, n"""


@query(WORKS)
def works_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps of the source of nested records, to one row a title."""
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    word = F.expr("repeat('y', cast(o_custkey % 6 AS int))")
    index = F.concat(F.lit('{"Abstract":[0],"of":[1],"'), F.when(word == "", "<b>").otherwise(word), F.lit('":[2]}'))
    empty = F.lit("")
    rows = table(spark, sf_dir, "orders").select(
        k, k.cast("string").alias("id"), F.concat(F.lit("https://doi.org/10.1/"), (cust % 4).cast("string")).alias("doi"), F.when(k % 2 == 0, F.concat(F.lit("Title: "), (k % 3000).cast("string"))).otherwise(" ").alias("title"),
        F.concat(F.lit("Title -- "), (k % 3000).cast("string"), F.lit("?")).alias("display_name"), F.year("o_orderdate").alias("publication_year"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("A"), cust.cast("string"))).alias("authors"),
        F.concat(F.expr("repeat('x', cast(o_custkey % 7 AS int))"), "o_orderstatus").alias("author_institutions"), index.alias("abstract_inverted_index"), F.lit('{"display_name":"t","domain":{"display_name":"d"}}').alias("primary_topic"),
        F.concat(F.lit('[{"display_name":"k'), (cust % 5).cast("string"), F.lit('","score":0.5}]')).alias("keywords"), empty.alias("concepts"), F.lit(1).alias("cited_by_count"), empty.alias("journal"), empty.alias("issn"), (k % 11).alias("eleventh"),
    )
    out = clean_works(rows, "o_orderkey", WorkRules(blocked={"eleventh": [3]}, phrases=()))
    return out.select(*[f"works_{c}" for c in ("title", "tag", "authors", "publication_year", "author_institutions", "abstract", "keywords", "doi_1")])
