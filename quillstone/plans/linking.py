"""Linkage and consolidation queries: odd documents against even ones, orders against customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as K
from ..functions import text as T
from ..operators import consolidate as D
from ..operators import linkage as L
from .facts import table
from .registry import query

# Titles: the first line of a document; keys as the sources build them.
DOCS = """docs AS (SELECT doc_id, text, source, lang, n_chars, md5(text) AS doi, split_part(text, chr(10), 1) AS title,
  regexp_replace(lower(split_part(text, chr(10), 1)), '[^\\p{L}\\p{N}]', '', 'g') AS title_key FROM documents)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.substring_index("text", "\n", 1)
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars", F.md5("text").alias("doi"), title.alias("title"), F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]", "").alias("title_key"))


LINK = f"""WITH {DOCS}, l AS (SELECT * FROM docs WHERE doc_id % 2 = 0), r AS (SELECT * FROM docs WHERE doc_id % 2 = 1),
l1 AS (SELECT doi AS k, min(doc_id) AS id FROM l WHERE doi <> '' GROUP BY doi HAVING count(*) = 1),
r1 AS (SELECT doi AS k, min(doc_id) AS id FROM r WHERE doi <> '' GROUP BY doi HAVING count(*) = 1),
m1 AS (SELECT l1.id AS left_id, r1.id AS right_id, 'doi' AS strategy FROM l1 JOIN r1 USING (k)),
l2 AS (SELECT title_key AS k, min(doc_id) AS id FROM l WHERE title_key <> '' AND doc_id NOT IN (SELECT left_id FROM m1) GROUP BY 1 HAVING count(*) = 1),
r2 AS (SELECT title_key AS k, min(doc_id) AS id FROM r WHERE title_key <> '' AND doc_id NOT IN (SELECT right_id FROM m1) GROUP BY 1 HAVING count(*) = 1),
m2 AS (SELECT l2.id AS left_id, r2.id AS right_id, 'title' AS strategy FROM l2 JOIN r2 USING (k)),
m AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2),
linked AS (SELECT * FROM m UNION ALL SELECT doc_id, NULL, 'left_only' FROM l WHERE doc_id NOT IN (SELECT left_id FROM m)
  UNION ALL SELECT NULL, doc_id, 'right_only' FROM r WHERE doc_id NOT IN (SELECT right_id FROM m))"""


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "doi", "title_key")
    left, right = docs.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "left_id"), docs.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "right_id")
    return L.staged_link(left, right, ("left_id", "right_id"), [("doi", "doi", "doi"), ("title", "title_key", "title_key")])


@query(LINK + " SELECT left_id, right_id, strategy FROM linked")
def staged_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir)


@query(LINK + " SELECT strategy, count(*) AS n FROM linked GROUP BY strategy")
def link_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).groupBy("strategy").agg(F.count("*").alias("n"))


TWO_PASS = """WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS left_id, l_orderkey AS doi, l_partkey AS last, l_suppkey % 3 AS first FROM lineitem WHERE l_linenumber % 2 = 0),
r AS (SELECT l_orderkey * 10 + l_linenumber AS right_id, l_orderkey AS doi, l_partkey % 50 AS last50, l_suppkey % 3 AS first FROM lineitem WHERE l_linenumber % 2 = 1),
ll AS (SELECT left_id, doi, last % 50 AS last, first FROM l), rr AS (SELECT right_id, doi, last50 AS last, first FROM r),
p AS (SELECT DISTINCT left_id, right_id FROM ll JOIN rr USING (doi, last, first)),
l2 AS (SELECT * FROM ll WHERE left_id NOT IN (SELECT left_id FROM p)), r2 AS (SELECT * FROM rr WHERE right_id NOT IN (SELECT right_id FROM p)),
o AS (SELECT left_id, right_id FROM l2 FULL JOIN r2 ON l2.doi = r2.doi AND l2.last = r2.last)
SELECT left_id, right_id, 'first_pass' AS strategy FROM p UNION ALL
SELECT left_id, right_id, CASE WHEN left_id IS NULL THEN 'right_only' WHEN right_id IS NULL THEN 'left_only' ELSE 'second_pass' END FROM o"""


def _two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("doi"), (F.col("l_partkey") % 50).alias("last"), (F.col("l_suppkey") % 3).alias("first"), "l_linenumber")
    left = rows.where("l_linenumber % 2 = 0").withColumnRenamed("id", "left_id")
    right = rows.where("l_linenumber % 2 = 1").withColumnRenamed("id", "right_id")
    return L.two_pass_outer(left, right, ("left_id", "right_id"), ["doi", "last", "first"], ["doi", "last"])


@query(TWO_PASS)
def two_pass_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_pass(spark, sf_dir)


# Blank keys, a third of all, make one heavy class.
HEAVY = """WITH rows AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE CAST(l_orderkey // 4 AS VARCHAR) END AS doi, l_partkey % 5 AS last, l_suppkey % 3 AS first, l_linenumber FROM lineitem),
l AS (SELECT * FROM rows WHERE l_linenumber % 2 = 0), r AS (SELECT * FROM rows WHERE l_linenumber % 2 = 1),
c1 AS (SELECT doi, last, first, a, b FROM (SELECT doi, last, first, count(*) AS a FROM l GROUP BY ALL) JOIN (SELECT doi, last, first, count(*) AS b FROM r GROUP BY ALL) USING (doi, last, first)),
l2 AS (SELECT * FROM l ANTI JOIN c1 USING (doi, last, first)), r2 AS (SELECT * FROM r ANTI JOIN c1 USING (doi, last, first)),
c2 AS (SELECT doi, last, a, b FROM (SELECT doi, last, count(*) AS a FROM l2 GROUP BY ALL) JOIN (SELECT doi, last, count(*) AS b FROM r2 GROUP BY ALL) USING (doi, last))
SELECT 'left' AS side, id, 'first_pass' AS strategy, a AS n_left, b AS n_right FROM l JOIN c1 USING (doi, last, first) UNION ALL SELECT 'right', id, 'first_pass', a, b FROM r JOIN c1 USING (doi, last, first)
UNION ALL SELECT 'left', id, 'second_pass', a, b FROM l2 JOIN c2 USING (doi, last) UNION ALL SELECT 'right', id, 'second_pass', a, b FROM r2 JOIN c2 USING (doi, last)
UNION ALL SELECT 'left', id, 'left_only', NULL, NULL FROM l2 ANTI JOIN c2 USING (doi, last) UNION ALL SELECT 'right', id, 'right_only', NULL, NULL FROM r2 ANTI JOIN c2 USING (doi, last)"""


@query(HEAVY)
def outer_link_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of both sides with its class of partners; a third of the keys is blank."""
    key = F.when(F.col("l_orderkey") % 3 == 0, "").otherwise(F.floor(F.col("l_orderkey") / 4).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), key.alias("doi"), (F.col("l_partkey") % 5).alias("last"), (F.col("l_suppkey") % 3).alias("first"), "l_linenumber")
    classes = L.outer_classes(rows.where("l_linenumber % 2 = 0"), rows.where("l_linenumber % 2 = 1"), ("id", "id"), ["doi", "last", "first"], ["doi", "last"])
    return classes.drop("class")


@query(
    f"""WITH t AS ({TWO_PASS}), g AS (SELECT *, (coalesce(left_id, right_id) / 10)::BIGINT // 1 AS x FROM t), d AS (SELECT left_id, right_id, strategy, coalesce(left_id, right_id) // 10 AS doi FROM g),
w AS (SELECT *, max((strategy = 'left_only')::INT) OVER (PARTITION BY doi) AS a, max((strategy = 'right_only')::INT) OVER (PARTITION BY doi) AS b FROM d)
SELECT doi, left_id, right_id, strategy FROM w WHERE NOT (a = 1 AND b = 1 AND strategy = 'right_only')"""
)
def conflict_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _two_pass(spark, sf_dir).select(F.floor(F.coalesce("left_id", "right_id") / 10).cast("long").alias("doi"), "left_id", "right_id", "strategy")
    return L.conflict_filter(rows, "doi", "strategy", "right_only")


@query(
    """WITH l AS (SELECT o_orderkey AS left_id, CAST(year(o_orderdate) AS INTEGER) AS y, o_custkey AS k1, o_custkey + 1 AS k2, o_custkey * 2406 + dayofyear(o_orderdate) AS t FROM orders WHERE o_orderkey % 2 = 0),
r AS (SELECT o_orderkey AS right_id, CAST(year(o_orderdate) AS INTEGER) AS y, o_custkey AS k, o_custkey * 2406 + dayofyear(o_orderdate) AS t FROM orders WHERE o_orderkey % 2 = 1),
lk AS (SELECT left_id, y, 0 AS pos, k1 AS k FROM l UNION ALL SELECT left_id, y, 1, k2 FROM l),
rk AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY y, k) AS n FROM r) WHERE n = 1),
m1 AS (SELECT left_id, right_id FROM (SELECT left_id, right_id, row_number() OVER (PARTITION BY left_id ORDER BY pos, right_id) AS rn FROM lk JOIN rk USING (y, k)) WHERE rn = 1),
l2 AS (SELECT * FROM l WHERE left_id NOT IN (SELECT left_id FROM m1)), r2 AS (SELECT *, count(*) OVER (PARTITION BY y, t) AS n FROM r WHERE right_id NOT IN (SELECT right_id FROM m1)),
m2 AS (SELECT left_id, right_id FROM (SELECT left_id, right_id, row_number() OVER (PARTITION BY left_id ORDER BY right_id) AS rn FROM l2 JOIN r2 USING (y, t) WHERE n = 1) WHERE rn = 1)
SELECT left_id, right_id, 'doi' AS strategy FROM m1 UNION ALL SELECT left_id, right_id, 'title' FROM m2"""
)
def year_scoped_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), "o_custkey", (F.col("o_custkey") * 2406 + F.dayofyear("o_orderdate")).cast("string").alias("t"))
    key = F.col("o_custkey")
    left = rows.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("left_id"), "y", F.array(key.cast("string"), (key + 1).cast("string")).alias("dois"), "t")
    right = rows.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("right_id"), "y", key.cast("string").alias("k"), "t")
    return L.year_scoped_link(left, right, ("left_id", "right_id"), "y", [("doi", "dois", "k"), ("title", "t", "t")])


@query(
    """SELECT o_orderkey, c_custkey, c_mktsegment, CASE WHEN c_custkey IS NULL THEN 'left_only' ELSE 'both' END AS indicator
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 20) ON c_custkey = o_custkey"""
)
def m1_left_join_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").where("c_nationkey < 20").select("c_custkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return L.lookup_join(orders, customers, F.col("o_custkey") == F.col("c_custkey"), ["c_custkey"], "indicator").select("o_orderkey", "c_custkey", "c_mktsegment", "indicator")


@query("""SELECT o_orderkey, lower(trim(o_orderpriority)) AS journal FROM orders WHERE regexp_replace(lower(trim('  ' || o_orderpriority || ' ')), '\\s+', ' ', 'g') IN ('1-urgent', '2-high')""")
def lookup_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IN-list filter on a normalized journal name with noise in it."""
    noisy = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")).alias("journal"))
    return noisy.withColumn("journal", F.lower(T.clean_text(F.col("journal")))).where(F.col("journal").isin("1-urgent", "2-high"))


@query(
    """WITH f AS (SELECT l_orderkey AS paper, list_sort(list(DISTINCT p_type)) AS fields FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT len(fields) AS n_fields, count(*) AS papers FROM f WHERE len(fields) > 1 GROUP BY 1"""
)
def multi_field_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    fields = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.countDistinct("p_type").alias("n_fields"))
    return fields.where("n_fields > 1").groupBy("n_fields").agg(F.count("*").alias("papers"))


@query(
    f"""WITH {DOCS}, d AS (SELECT * FROM docs WHERE title_key <> '')
SELECT title_key, max_by(source, length(source) * 1000000000 - doc_id) AS source, max_by(title, length(title) * 1000000000 - doc_id) AS title, count(*) AS rows FROM d GROUP BY title_key"""
)
def consolidate_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).where("title_key <> ''").select("doc_id", "title_key", "source", "title")
    return D.consolidate(rows, "title_key", ["source", "title"], "doc_id")


@query(
    f"""WITH {DOCS}, b AS (SELECT title_key, max_by(text, length(text) * 1000000000 - doc_id) AS best FROM docs GROUP BY title_key)
SELECT doc_id, title_key, md5(best) AS best_md5, length(best) AS best_chars FROM docs JOIN b USING (title_key)"""
)
def longest_value_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row takes the longest text of its title."""
    rows = D.share_longest(_docs(spark, sf_dir).select("doc_id", "title_key", "text"), "title_key", "text", "doc_id")
    return rows.select("doc_id", "title_key", F.md5("text").alias("best_md5"), F.length("text").cast("long").alias("best_chars"))


@query(
    f"""WITH {DOCS}, s AS (SELECT title_key, count(*) AS n FROM docs WHERE title_key <> '' GROUP BY 1)
SELECT count(*) FILTER (n > 1) AS duplicate_groups, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows, max(n) AS largest_group, count(*) AS distinct_keys FROM s"""
)
def duplicate_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.duplicate_stats(_docs(spark, sf_dir).select("title_key"), "title_key")


@query(f"WITH {DOCS} SELECT doc_id, doi, source FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY n_chars DESC, doc_id DESC) AS rn FROM docs) WHERE rn = 1")
def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.keep_one(_docs(spark, sf_dir).select("doc_id", "doi", "source", "n_chars"), ["doi"], [F.desc("n_chars"), F.desc("doc_id")]).select("doc_id", "doi", "source")


@query(f"WITH {DOCS}, d AS (SELECT doc_id, title_key, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS authors, count(*) OVER (PARTITION BY title_key) AS n FROM docs) SELECT doc_id, authors FROM d WHERE NOT (n > 1 AND authors = '')")
def duplicate_title_blank_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", "title_key", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("authors"))
    return D.drop_blank_author_copies(rows, "title_key", "authors").select("doc_id", "authors")


def _variants(c: Column) -> tuple[Column, Column, Column]:
    return F.when(F.col("c_custkey") % 3 == 0, F.lit("  ")).otherwise(c), F.when(F.col("c_custkey") % 5 == 0, F.lit("")).otherwise(F.col("c_mktsegment")), F.col("n_name")


@query(
    """WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_name END AS a, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS b, n_name AS c FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, coalesce(nullif(trim(a), ''), nullif(trim(b), ''), nullif(trim(c), ''), '') AS first_value,
  CASE WHEN trim(a) <> '' THEN 'name' WHEN trim(b) <> '' THEN 'segment' WHEN trim(c) <> '' THEN 'nation' ELSE '' END AS from_column,
  CASE WHEN trim(a) = '' AND trim(b) <> '' THEN b ELSE a END AS filled, CASE WHEN trim(b) <> '' THEN b ELSE a END AS preferred FROM v"""
)
def coalesce_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    a, b, c = _variants(F.col("c_name"))
    return rows.select("c_custkey", K.first_nonblank(a, b, c).alias("first_value"), K.first_nonblank_source({"name": a, "segment": b, "nation": c}).alias("from_column"), K.fill_blank(a, b).alias("filled"), K.prefer(a, b).alias("preferred"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN upper(n_name) ELSE s_name END AS label, CASE WHEN s_suppkey % 4 = 0 THEN 'predicted' ELSE 'observed' END AS label_source FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def observed_else_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    observed = F.when(F.col("s_suppkey") % 4 == 0, " ").otherwise(F.col("s_name"))
    rows = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", K.observed_or_predicted(observed, F.upper("n_name")).alias("label"), F.when(K.blank(observed), "predicted").otherwise("observed").alias("label_source"))


@query("WITH c AS (SELECT c_custkey AS id, 'customer' AS record_status, c_acctbal AS balance, 1 AS observed FROM customer), s AS (SELECT s_suppkey AS id, 'supplier' AS record_status, s_acctbal AS balance, 0 AS observed FROM supplier) SELECT * FROM c UNION ALL SELECT * FROM s")
def union_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("record_status"), F.col("c_acctbal").alias("balance"), F.lit(1).alias("observed"))
    suppliers = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("record_status"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), F.lit(0).alias("observed"))
    return customers.unionByName(suppliers, allowMissingColumns=True)


@query("SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40) AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def semi_anti_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"))
    closed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(parts, "l_partkey", "left_semi").join(closed, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("lines"))


@query(
    """SELECT * FROM (SELECT nation, segment, CAST(row_number() OVER (PARTITION BY nation ORDER BY n DESC, segment) AS INTEGER) AS place, n FROM (SELECT n_name AS nation, c_mktsegment AS segment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)) WHERE place <= 2"""
)
def top_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two commonest segments of each nation (a top-k report)."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    counts = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("nation", F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("nation").orderBy(F.desc("n"), "segment"))).where("place <= 2")
