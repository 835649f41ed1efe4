"""Abstract, code, date, identifier and nested record queries; JSON cells are made of the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as K
from ..functions import records as J
from ..functions import text as T
from .facts import table
from .registry import query

CODE_SQL = r"(?:JEL|JEL\s+classification|JEL\s+classifications|JEL\s+codes?|JEL\s+No\.?)"
ABSTRACT = """raw AS (SELECT p_partkey, '<p>Abstract: ' || p_name || ' &amp;amp; more.</p> ' || CASE p_partkey % 4 WHEN 0 THEN 'JEL Classification: d' || lpad(CAST(p_size AS VARCHAR), 2, '0') || ', G10; e31. Rest' WHEN 1 THEN 'Classification-JEL: C1, C2; Tail' WHEN 2 THEN 'jel codes - A12' ELSE 'No codes B22' END AS text FROM part)"""


def _abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey") % 4
    tail = F.when(key == 0, F.concat(F.lit("JEL Classification: d"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(", G10; e31. Rest")))
    tail = tail.when(key == 1, "Classification-JEL: C1, C2; Tail").when(key == 2, "jel codes - A12").otherwise("No codes B22")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("<p>Abstract: "), "p_name", F.lit(" &amp;amp; more.</p> "), tail).alias("text"))


@query(
    f"""WITH {ABSTRACT}, c AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, '&amp;amp;', '&'), '<[^>]+>', ' ', 'g'), '(?i){CODE_SQL}[^.;\\n]*[A-Z][0-9]{{2}}(?:\\s*[,;/]\\s*[A-Z][0-9]{{2}})*\\.?', ' ', 'g'), '(?i)Classification-JEL:[^.;\\n]*\\.?', ' ', 'g'), '\\s+', ' ', 'g')) AS abstract,
  CASE p_partkey % 4 WHEN 0 THEN list_distinct(['D' || regexp_extract(text, 'd(\\d\\d)', 1), 'G10', 'E31']) WHEN 2 THEN ['A12'] ELSE [] END AS own FROM raw)
SELECT p_partkey, abstract, regexp_replace(abstract, '(?i)^abstract[\\s:.]*', '') AS unlabelled, array_to_string(own, '; ') AS codes FROM (SELECT * REPLACE (CASE WHEN p_partkey % 4 = 0 THEN list_concat([own[1]], list_filter(['D' || '', 'G10', 'E31'], lambda x: length(x) = 3 AND x <> own[1])) ELSE own END AS own) FROM (SELECT c.* REPLACE (CASE WHEN c.p_partkey % 4 = 0 THEN ['D' || lpad(CAST(p_size AS VARCHAR), 2, '0'), 'G10', 'E31'] ELSE own END AS own) FROM c JOIN part USING (p_partkey)))"""
)
def abstract_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References decoded, tags and announced codes dropped; the codes themselves in order."""
    text = F.col("text")
    return _abstracts(spark, sf_dir).select("p_partkey", T.clean_abstract(text).alias("abstract"), T.clean_abstract(text, label=True).alias("unlabelled"), F.array_join(T.announced_codes(text), "; ").alias("codes"))


@query(f"WITH {ABSTRACT} SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'D' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '; G10; E31' WHEN 2 THEN 'A12' ELSE '' END AS codes FROM raw JOIN part USING (p_partkey)")
def nearby_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announced codes, else those close after the announcement."""
    return _abstracts(spark, sf_dir).select("p_partkey", F.array_join(T.nearby_codes(F.col("text")), "; ").alias("codes"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(year(o_orderdate) AS INTEGER) WHEN 1 THEN CAST(year(o_orderdate) AS INTEGER) WHEN 2 THEN 1901 ELSE NULL END AS y,
  CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '' WHEN 2 THEN '1901' ELSE '' END AS published, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
  CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE '1950' END AS likely, CAST(year(o_orderdate) AS INTEGER) AS file_year FROM orders"""
)
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years and dates of nested date parts in five fields, of date texts, of free text, and of file names."""
    key, y, m, d = F.col("o_orderkey"), F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    record = (
        F.when(key % 4 == 0, F.format_string('{"published":{"date-parts":[[%d,%d,%d]]},"created":{"date-parts":[[1800]]}}', y, m, d))
        .when(key % 4 == 1, F.format_string('{"published":null,"issued":{"date-parts":[["%d",%d]]}}', y, m))
        .when(key % 4 == 2, '{"published":{"date-parts":[[1901]]}}')
        .otherwise('{"published":{"date-parts":[[null]]}}')
    )
    day = F.when(key % 5 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    free = F.when(key % 3 == 0, "9999 or 2099 and 1999").when(key % 3 == 1, F.concat(F.lit("about "), y.cast("string"))).otherwise("1950-1960")
    path = F.concat(F.lit("/data/1888/works_"), y.cast("string"), F.lit(".jsonl"))
    return table(spark, sf_dir, "orders").select("o_orderkey", J.date_year(record).alias("y"), J.date_text(record, "published").alias("published"), J.date_or_blank(day).alias("day"), J.likely_year(free, 2030).alias("likely"), J.year_from_path(path).alias("file_year"))


@query(
    """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '10.1/x' WHEN 1 THEN s_name ELSE '' END AS paper, CASE WHEN s_suppkey % 2 = 0 THEN '10.3386/w' || s_suppkey ELSE '' END AS paper_doi, 'https://x.org/w' || s_suppkey AS work,
  CASE WHEN s_suppkey % 4 = 0 THEN 'a' WHEN s_suppkey % 4 = 1 THEN 'a; b' ELSE 'b; c' END AS address, CASE WHEN s_suppkey % 5 = 0 THEN s_name || ': b' ELSE 'b' END AS named FROM supplier"""
)
def paper_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of papers and works, and addresses of several pieces."""
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    second = F.when(key % 4 == 0, "a").when(key % 4 == 1, " b ").otherwise("b")
    third = F.when(key % 4 < 2, "\\N").otherwise("c")
    return rows.select("s_suppkey", J.paper_identifier(F.when(key % 3 == 0, " 10.1/x "), F.when(key % 3 == 1, F.col("s_name"))).alias("paper"), J.paper_doi(F.concat(F.when(key % 2 == 0, " W").otherwise("h"), key.cast("string"))).alias("paper_doi"), J.work_id(F.concat(F.lit(" https://X.org/W"), key.cast("string"))).alias("work"), J.address(F.when(key % 4 < 2, "a"), second, third).alias("address"), J.named_address(F.when(key % 5 == 0, F.col("s_name")), F.lit("b")).alias("named"))


@query(
    """WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 2 AS level, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn,
  CASE WHEN l_linenumber = 2 THEN 'k' || l_partkey ELSE printf('k%d (%.3f)', l_partkey, l_quantity / 100) END AS shown FROM lineitem)
SELECT l_orderkey, coalesce(string_agg(shown, '; ' ORDER BY rn) FILTER (l_linenumber <> 5), '') AS keywords, coalesce(string_agg(shown, '; ' ORDER BY rn) FILTER (rn <= 3 AND l_linenumber <> 5), '') AS top3,
  coalesce(string_agg(shown, '; ' ORDER BY rn) FILTER (level = 0), '') AS level0, coalesce(max('k' || l_partkey) FILTER (rn = 1 AND l_linenumber <> 5), '') AS first_plain, coalesce(CAST(min(l_suppkey) FILTER (l_linenumber = 1) AS VARCHAR), '') AS domain FROM i GROUP BY l_orderkey"""
)
def scored_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored names of JSON lists: all, the first three, those of level 0; nested display names."""
    n = F.col("l_linenumber")
    name = F.when(n == 5, "").otherwise(F.concat(F.lit("k"), F.col("l_partkey").cast("string")))
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", name.alias("display_name"), F.when(n != 2, (F.col("l_quantity") / 100).cast("double")).alias("score"), (n % 2).alias("level"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"), F.min(F.when(n == 1, F.col("l_suppkey"))).alias("s"))
    rows = lines.select("l_orderkey", F.to_json("items").alias("json"), F.to_json(F.struct(F.struct(F.col("s").cast("string").alias("display_name")).alias("domain"))).alias("topic"))
    json = F.col("json")
    return rows.select("l_orderkey", J.scored_names(json).alias("keywords"), J.scored_names(json, most=3).alias("top3"), J.scored_names(json, level=0).alias("level0"), J.plain_keyword(J.scored_names(json, most=1)).alias("first_plain"), J.json_value(F.col("topic"), "$.domain.display_name").alias("domain"))


@query(
    """SELECT l_orderkey, coalesce(string_agg('A' || l_partkey, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_linenumber % 3 <> 0), '') AS authors, string_agg('raw ' || l_partkey, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS raw_author_names,
  string_agg(CASE WHEN l_linenumber % 2 = 0 THEN 'S' || l_suppkey || ' | T' || l_suppkey ELSE 'S' || l_suppkey END, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS author_institutions, coalesce(string_agg('i' || l_suppkey, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_linenumber % 2 = 0), '') AS author_institution_ids,
  count(*) FILTER (l_linenumber % 3 <> 0) AS n FROM lineitem GROUP BY l_orderkey"""
)
def authorship_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authorships flattened to parallel lists; blank entries leave no gap."""
    n, part, sup = F.col("l_linenumber"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    author = F.struct(F.when(n % 3 != 0, F.concat(F.lit("A"), part)).otherwise(" ").alias("display_name"))
    own = F.struct(F.concat(F.lit("S"), sup).alias("display_name"), F.lit(None).cast("string").alias("id"))
    more = F.struct(F.concat(F.lit("T"), sup).alias("display_name"), F.concat(F.lit("i"), sup).alias("id"))
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", author.alias("author"), F.concat(F.lit(" raw "), part).alias("raw_author_name"), F.when(n % 2 == 0, F.array(own, more)).otherwise(F.array(own)).alias("institutions"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("json"))
    out = J.authorship_lists(rows, "json")
    return out.select("l_orderkey", "authors", "raw_author_names", "author_institutions", "author_institution_ids", F.size(K.split_cell(F.col("authors"))).cast("long").alias("n"))


@query(
    """SELECT o_orderkey, c_name || ' ' || CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE 'Y' END || '; Org' AS authors, c_name AS author_given, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE 'Y' END AS author_family, 'first' AS author_sequence, 'U | V' AS author_affiliations FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def person_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry persons flattened to parallel lists; a missing name is made of its parts."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    family = F.when(F.col("o_orderkey") % 2 == 0, " X ").otherwise("Y")
    place = F.array(F.struct(F.lit("U").alias("name")), F.struct(F.lit("").alias("name")), F.struct(F.lit("V").alias("name")))
    people = F.array(F.struct(F.col("c_name").alias("given"), family.alias("family"), F.lit(None).cast("string").alias("name"), F.lit("first").alias("sequence"), place.alias("affiliation")), F.struct(F.lit(None).cast("string").alias("given"), F.lit(None).cast("string").alias("family"), F.lit("Org").alias("name"), F.lit("").alias("sequence"), F.slice(place, 2, 1).alias("affiliation")))
    out = J.person_lists(rows.select("o_orderkey", F.to_json(people).alias("json")), "json")
    return out.select("o_orderkey", "authors", "author_given", "author_family", "author_sequence", "author_affiliations")


@query(
    """SELECT event_id, '$.k' AS path, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events UNION ALL SELECT event_id, '$.in.list[0]', event_type FROM events UNION ALL SELECT event_id, '$.in.list[1]', CAST(user_id AS VARCHAR) FROM events"""
)
def json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scalar of a nested record with its path."""
    k = F.get_json_object("props", "$.k").cast("int")
    record = F.to_json(F.struct(k.alias("k"), F.struct(F.array(F.col("event_type"), F.col("user_id").cast("string")).alias("list")).alias("in")))
    rows = table(spark, sf_dir, "events").select("event_id", record.alias("json"))
    return J.walk(rows, "json", ["event_id"])


@query("SELECT p_partkey, p_name AS first_value, CASE WHEN p_partkey % 2 = 0 THEN p_name || '; ' || p_type ELSE '' END AS joined FROM part")
def json_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and joined values of JSON cells, plain or lists."""
    even = F.col("p_partkey") % 2 == 0
    cell = F.when(even, F.to_json(F.array("p_name", F.lit(" "), "p_type"))).otherwise(F.concat("p_name", F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", J.first_json_value(cell).alias("first_value"), J.joined_json(cell).alias("joined"))
