"""Reshaping, text, identifier, date and JSON queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as K
from ..functions import text as T
from ..operators import consolidate as D
from ..operators import ranking as R
from ..sources.html_meta import page_metadata
from ..streaming import events as E
from .facts import table
from .registry import query


@query(
    """WITH d AS (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2)
SELECT conv_id, string_agg(role, '; ' ORDER BY first) AS roles, count(*) AS n_roles FROM d GROUP BY conv_id"""
)
def ordered_distinct_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(D.distinct_in_order("role", "turn").alias("roles"))
    return rows.select("conv_id", "roles", F.size(F.split("roles", "; ")).cast("long").alias("n_roles"))


@query("SELECT p_partkey, CAST(i AS INTEGER) AS position, split_part(p_name, ' ', i) AS word FROM part, (SELECT unnest(range(1, 10)) AS i) WHERE i <= len(string_split(p_name, ' '))")
def split_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.explode_cell(table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ; ", F.split("p_name", " ")).alias("cell")), "cell", "word").select("p_partkey", "position", "word")


@query(
    """SELECT p_partkey, CAST(i AS INTEGER) AS position, coalesce(string_split(p_name, ' ')[i], '') AS given, coalesce(string_split(p_type, ' ')[i], '') AS family
FROM part, (SELECT unnest(range(1, 10)) AS i) WHERE i <= greatest(len(string_split(p_name, ' ')), len(string_split(p_type, ' ')))"""
)
def zip_longest_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return K.explode_parallel(rows, "p_name", "p_type", ("given", "family"), by=" ")


@query(
    """WITH a AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS v FROM orders GROUP BY 1)
SELECT o_custkey, coalesce(v[1], '') AS doi_1, coalesce(v[2], '') AS doi_2, coalesce(v[3], '') AS doi_3, array_to_string(v, '; ') AS doi_full FROM a"""
)
def array_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("v"))
    return K.versions(rows, "v", "doi_", 3).select("o_custkey", "doi_1", "doi_2", "doi_3", F.array_join("v", "; ").alias("doi_full"))


@query(
    """SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1"""
)
def pivot_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.pivot_counts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"], F.count(F.lit(1)))


@query(
    r"""SELECT doc_id, regexp_replace(lower(trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g'))), '[^\p{L}\p{N}]', '', 'g') AS compact,
  trim(regexp_replace(replace(replace(lower(split_part(text, chr(10), 1)), '&amp;', ' and '), '&', ' and '), '[^\p{L}\p{N}]+', ' ', 'g')) AS spaced,
  trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', ' ', 'g')) AS ascii,
  trim(regexp_replace(split_part(text, chr(10), 1), '[^\p{L}\p{N}]+', ' ', 'g')) AS cased FROM documents"""
)
def normalize_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"))
    title = F.col("title")
    return rows.select("doc_id", *[T.title_key(title, v).alias(v) for v in ("compact", "spaced", "ascii")], T.letters_and_numbers(title).alias("cased"))


@query(
    r"""WITH u AS (SELECT page_id, CASE WHEN page_id % 23 = 0 THEN 'NULL' ELSE CASE page_id % 4 WHEN 0 THEN 'https://doi.org/' WHEN 1 THEN 'http://dx.doi.org/' WHEN 2 THEN 'doi:' ELSE ' https://dx.doi.org/' END || '10.' || page_id || '/AB.' || CASE WHEN page_id % 3 = 0 THEN '.' ELSE '' END END AS raw FROM pages)
SELECT page_id, replace(replace(replace(trim(raw), 'https://doi.org/', ''), 'http://doi.org/', ''), 'http://dx.doi.org/', '') AS works,
  replace(replace(replace(lower(trim(raw)), 'https://doi.org/', ''), 'http://doi.org/', ''), 'http://dx.doi.org/', '') AS scrape,
  regexp_replace(lower(trim(raw)), '^(https://doi\.org/|http://doi\.org/|https://dx\.doi\.org/|http://dx\.doi\.org/|doi:)', '') AS prefix,
  rtrim(replace(replace(replace(replace(replace(lower(trim(raw)), 'https://doi.org/', ''), 'http://doi.org/', ''), 'https://dx.doi.org/', ''), 'http://dx.doi.org/', ''), 'doi:', ''), '.,;') AS papers,
  rtrim(regexp_replace(lower(trim(raw)), '^(https://doi\.org/|http://doi\.org/|https://dx\.doi\.org/|http://dx\.doi\.org/|doi:)', ''), '.') AS records,
  rtrim(replace(replace(replace(lower(trim(raw)), 'https://doi.org/', ''), 'http://doi.org/', ''), 'http://dx.doi.org/', ''), '.,;') AS "all", replace(replace(lower(trim(raw)), 'https://doi.org/', ''), 'http://dx.doi.org/', '') AS collected,
  CASE WHEN raw = 'NULL' THEN '' ELSE rtrim(replace(replace(replace(lower(trim(raw)), 'https://doi.org/', ''), 'http://doi.org/', ''), 'http://dx.doi.org/', ''), '.,;') END AS working FROM u"""
)
def normalize_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, end = F.col("page_id"), F.when(F.col("page_id") % 3 == 0, ".").otherwise("")
    start = F.when(page % 4 == 0, "https://doi.org/").when(page % 4 == 1, "http://dx.doi.org/").when(page % 4 == 2, "doi:").otherwise(" https://dx.doi.org/")
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(page % 23 == 0, "NULL").otherwise(F.concat(start, F.lit("10."), page.cast("string"), F.lit("/AB."), end)).alias("raw"))
    return rows.select("page_id", *[T.doi_key(F.col("raw"), **T.DOI_VARIANTS[v]).alias(v) for v in T.DOI_VARIANTS])


@query(
    r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_replace(regexp_replace(lower(url), '^https?://(www\.|m\.|blog\.)?', ''), '[/?#].*$', '') AS site,
  regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') AS bare_url, coalesce(TRY_CAST(regexp_extract(url, '/(\d+)', 1) AS INTEGER), -1) AS number FROM pages"""
)
def normalize_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    site = F.regexp_replace(F.regexp_replace(F.lower(url), r"^https?://(www\.|m\.|blog\.)?", ""), "[/?#].*$", "")
    bare = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), site.alias("site"), bare.alias("bare_url"), F.coalesce(T.whole(F.regexp_extract("url", r"/(\d+)", 1)), F.lit(-1)).alias("number"))


@query(
    r"""WITH c AS (SELECT p_partkey, 'JEL: ' || substr(p_brand, 7, 1) || 'D' || lpad(CAST(p_size AS VARCHAR), 2, '0') || ', G' || lpad(CAST(p_partkey % 40 AS VARCHAR), 2, '0') || '; e1 Q' AS raw FROM part)
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(upper(raw), '\b[A-Z](?:\d{2})?\b'), lambda x: x[1]), '') AS letters, regexp_extract(upper(raw), '\b([A-Z])\d{0,2}\b', 1) AS first_letter FROM c"""
)
def extract_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("JEL: "), F.substring("p_brand", 7, 1), F.lit("D"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(", G"), F.lpad((F.col("p_partkey") % 40).cast("string"), 2, "0"), F.lit("; e1 Q"))
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    return rows.select("p_partkey", F.array_join(T.code_letters(F.col("raw")), "").alias("letters"), F.regexp_extract(F.upper("raw"), r"\b([A-Z])\d{0,2}\b", 1).alias("first_letter"))


@query(
    r"""WITH t AS (SELECT o_orderkey, 'from ' || CAST(year(o_orderdate) AS VARCHAR) || ' to 2' || CASE WHEN o_orderkey % 2 = 0 THEN '013 in ' ELSE '13 in ' END || strftime(o_orderdate, '%B') AS raw FROM orders)
SELECT o_orderkey, regexp_extract(raw, '\b((19|20)\d{2})\b', 1) AS first_year, CASE WHEN o_orderkey % 2 = 0 THEN '2013' ELSE regexp_extract(raw, '\b((19|20)\d{2})\b', 1) END AS last_year,
  CAST(list_position(['January','February','March','April','May','June','July','August','September','October','November','December'], split_part(raw, ' ', 6)) AS INTEGER) AS month FROM t"""
)
def extract_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("from "), F.year("o_orderdate").cast("string"), F.lit(" to 2"), F.when(F.col("o_orderkey") % 2 == 0, "013 in ").otherwise("13 in "), F.date_format("o_orderdate", "MMMM"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.select("o_orderkey", T.year_in(F.col("raw")).alias("first_year"), T.year_in(F.col("raw"), last=True).alias("last_year"), T.month_in(F.col("raw")).alias("month"))


@query(
    """SELECT doc_id, source FROM documents WHERE NOT (contains(lower(text), 'license') OR contains(lower(text), 'password=') OR contains(lower(text), 'released under'))"""
)
def title_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring blocklist, any case, anywhere."""
    rows = table(spark, sf_dir, "documents").where(~T.is_not_paper(F.col("text"), ["License", "password=", "Released under"]))
    return rows.select("doc_id", "source")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_keys(props)[1] AS first_key FROM events""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.from_json("props", "k INT")["k"].alias("k"), F.get(F.json_object_keys("props"), 0).alias("first_key"))


@query()
def inverted_index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts to inverted indexes and back; a text without words comes back empty."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")
    index = table(spark, sf_dir, "documents").select("doc_id", T.inverted_index(words).alias("index"))
    return index.select("doc_id", T.inverted_index_text(F.col("index")).alias("text"))


@query(
    """SELECT c_custkey, TRY_CAST(CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE) AS number, round(CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_acctbal / (c_custkey % 4) END, 6) AS share,
  round(1 / (1 + exp(-c_acctbal / 1000)), 9) AS sigmoid FROM customer"""
)
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    text = F.when(F.col("c_custkey") % 3 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    return rows.select("c_custkey", T.number(text).alias("number"), F.round(T.safe_share(F.col("c_acctbal"), F.col("c_custkey") % 4), 6).alias("share"), F.round(T.sigmoid(F.col("c_acctbal") / 1000), 9).alias("sigmoid"))


@query("SELECT conv_id, turn, role, lag(role) OVER w AS previous_role, CAST(row_number() OVER w AS INTEGER) AS place FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def turn_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("previous_role"), F.row_number().over(w).alias("place"))


@query(
    r"""SELECT page_id, trim(regexp_extract(html, '<html lang="([^"]*)"', 1)) AS lang, regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset,
  CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS paragraphs FROM pages"""
)
def html_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    found = rows.select("page_id", F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).alias("paragraphs"), page_metadata("html").alias("m"))
    return found.select("page_id", "m.lang", "m.charset", "paragraphs")


@query()
def html_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", page_metadata("html").alias("m")).select("page_id", "m.*")


@query(
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"""
)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming extra on the table; tests run the same plan on a stream."""
    return E.windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(avg(l_discount), 9) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP '2001-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.avg("l_discount"), 9).alias("avg_disc"), F.count("*").alias("count_order"))


@query(
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(table(spark, sf_dir, "events"))


@query(
    """SELECT l_orderkey * 10 + l_linenumber AS line, row_number() OVER (ORDER BY l_linestatus, l_extendedprice DESC, l_returnflag DESC, l_orderkey, l_linenumber) AS place FROM lineitem"""
)
def sorted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's place in one order of the whole table, some keys ascending and some descending."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_extendedprice", "l_returnflag")
    order = [F.col("l_linestatus"), F.desc("l_extendedprice"), F.desc("l_returnflag"), F.col("l_orderkey"), F.col("l_linenumber")]
    placed = R.sorted_places(rows, order, "place")
    return placed.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "place")


@query(
    """WITH f AS (SELECT l_orderkey, list_distinct(list(CAST(l_partkey % 9 AS VARCHAR))) AS modes, list_distinct(list(l_returnflag)) AS flags FROM lineitem GROUP BY 1)
SELECT l_orderkey, coalesce(array_to_string(list_sort(list_filter(modes, lambda x: x IN ('1', '3', '5', 'none'))), ';'), '') AS given, coalesce(array_to_string(list_sort(list_filter(modes, lambda x: x NOT IN ('1', '3', '5', 'none'))), ';'), '') AS other,
  coalesce(array_to_string(list_sort(list_filter(flags, lambda x: x <> 'N')), ';'), '') AS flags, 'matched' AS record_status FROM f"""
)
def value_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's values among some given ones, and the others."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set((F.col("l_partkey") % 9).cast("string")).alias("modes"), F.collect_set("l_returnflag").alias("flags"))
    given = F.array(*[F.lit(x) for x in ("1", "3", "5", "none")])
    rows = lines.select("l_orderkey", F.array_join(K.common_values(F.col("modes"), given), ";").alias("given"), F.array_join(K.other_values(F.col("modes"), given), ";").alias("other"), F.array_join(K.other_values(F.col("flags"), F.array(F.lit("N"))), ";").alias("flags"))
    return K.with_constants(rows, record_status="matched")
