"""Name, identity, evidence and checkpoint queries; part names stand in for author names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.columns import ordered_reasons
from ..operators import names as N
from ..operators import scoring as S
from .facts import table
from .registry import query

# Name variants: every 7th part an initial, other odd ones the first three letters.
NAMES = """nm AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN substr(split_part(p_name, ' ', 1), 1, 1) WHEN p_partkey % 2 = 1 THEN substr(split_part(p_name, ' ', 1), 1, 3)
  ELSE split_part(p_name, ' ', 1) END AS first, split_part(p_name, ' ', 2) AS last FROM part),
ks AS (SELECT DISTINCT regexp_replace(lower(last), '[^a-z0-9]', '', 'g') || '_' || regexp_replace(lower(first), '[^a-z0-9]', '', 'g') AS key, lower(first) AS first, lower(last) AS last FROM nm)"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("p_name", " ")
    first = parts[0]
    first = F.when(F.col("p_partkey") % 7 == 0, F.substring(first, 1, 1)).when(F.col("p_partkey") % 2 == 1, F.substring(first, 1, 3)).otherwise(first)
    return table(spark, sf_dir, "part").select("p_partkey", first.alias("first"), parts[1].alias("last"))


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _names(spark, sf_dir)
    return rows.select(F.concat(T.name_key(F.col("last")), F.lit("_"), T.name_key(F.col("first"))).alias("key"), F.lower("first").alias("first"), F.lower("last").alias("last")).distinct()


@query(
    """WITH n AS (SELECT p_partkey, trim(regexp_replace(p_name || CASE p_partkey % 4 WHEN 0 THEN ' Jr.' WHEN 1 THEN ', III' ELSE '' END, '(?i)([\\s,]+(jr\\.?|sr\\.?|ii|iii|iv))+$', '')) AS full_name FROM part)
SELECT p_partkey, full_name, CASE WHEN contains(full_name, ' ') THEN split_part(full_name, ' ', 1) ELSE '' END AS first_name, split_part(full_name, ' ', -1) AS last_name, split_part(full_name, ' ', -1) || ', ' || split_part(full_name, ' ', 1) AS reversed_name FROM n"""
)
def name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("p_partkey") % 4 == 0, " Jr.").when(F.col("p_partkey") % 4 == 1, ", III").otherwise("")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", suffix).alias("given"))
    first, last = T.first_last(F.col("given"))
    return rows.select("p_partkey", T.without_suffix(F.col("given")).alias("full_name"), first.alias("first_name"), last.alias("last_name"), F.concat_ws(", ", last, first).alias("reversed_name"))


@query(
    r"""SELECT c_custkey, regexp_replace(lower(trim(c_name)), '[^a-z0-9]', '', 'g') AS name_key, replace(replace(c_name, '#', ' '), '0', '') AS display, trim(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g')) AS ascii_key FROM customer"""
)
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", T.name_key(F.col("c_name")).alias("name_key"), F.translate("c_name", "#0", " ").alias("display"), T.letters_and_numbers(F.col("c_name"), ascii_only=True).alias("ascii_key"))


@query(f"WITH {NAMES} SELECT p_partkey, 'AEX' || lpad(CAST(dense_rank() OVER (ORDER BY lower(last) || '_' || lower(first)) AS VARCHAR), 6, '0') AS exact_id, lower(last) || '_' || lower(first) AS key FROM nm")
def exact_author_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _names(spark, sf_dir).select("p_partkey", F.concat(F.lower("last"), F.lit("_"), F.lower("first")).alias("key"))
    return N.exact_groups(rows, "key").select("p_partkey", "exact_id", "key")


PAIRS = f"""{NAMES}, pairs AS (SELECT a.key AS key_a, b.key AS key_b, 'prefix' AS reason FROM ks a JOIN ks b ON a.last = b.last AND a.key < b.key
  WHERE least(length(a.first), length(b.first)) >= 3 AND (starts_with(a.first, b.first) OR starts_with(b.first, a.first))),
fulls AS (SELECT last, substr(first, 1, 1) AS i, min(key) AS k FROM ks WHERE length(first) > 1 GROUP BY ALL HAVING count(*) = 1),
inits AS (SELECT least(key, k) AS key_a, greatest(key, k) AS key_b, 'unique initial' AS reason FROM ks JOIN fulls ON ks.last = fulls.last AND ks.first = i),
edges AS (SELECT * FROM pairs UNION ALL SELECT * FROM inits)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys(spark, sf_dir)
    return N.prefix_pairs(keys).union(N.initial_pairs(keys))


@query(f"WITH {PAIRS} SELECT * FROM edges")
def cautious_prefix_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query(
    f"""WITH RECURSIVE {PAIRS}, both_ways AS (SELECT key_a AS a, key_b AS b FROM edges UNION SELECT key_b, key_a FROM edges),
reach(node, r) AS (SELECT a, a FROM both_ways UNION SELECT reach.node, b FROM reach JOIN both_ways ON reach.r = both_ways.a)
SELECT node, min(r) AS component FROM reach GROUP BY node"""
)
def author_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.components(_edges(spark, sf_dir).select(F.col("key_a").alias("a"), F.col("key_b").alias("b")))


def title_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, first, last``: every two words that stand side by side in a title, as a person's names.

    Words are lower case; a frequent last word makes a large block.
    """
    words = F.filter(F.split(F.lower(F.substring_index("text", "\n", 1)), r"[^\p{L}]+"), lambda w: w != "")
    titles = table(spark, sf_dir, "documents").select(words.alias("w")).where(F.size("w") > 1)
    both = F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("first"), F.slice("w", 2, F.size("w") - 1).alias("last"))
    rows = titles.select(F.explode(both).alias("n")).select(F.concat_ws("_", "n.last", "n.first").alias("key"), "n.first", "n.last")
    return rows.distinct()


@query()
def fuzzy_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence similarity of first names in a last-name block (no SQL has this measure)."""
    return N.similar_pairs(title_names(spark, sf_dir))


@query()
def greedy_overlap_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy one-to-one matches of the names of an order's odd and even lines by common substring."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_linenumber", "p_name")
    left = rows.where("l_linenumber % 2 = 1").select("l_orderkey", F.col("id").alias("l_id"), F.col("p_name").alias("l_name"))
    right = rows.where("l_linenumber % 2 = 0").select("l_orderkey", F.col("id").alias("r_id"), F.col("p_name").alias("r_name"))
    return N.greedy_overlap(left, right, "l_orderkey", 0.5)


@query()
def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with references decoded and folded to ASCII (no SQL has the same folding)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"))
    return rows.select("doc_id", T.to_ascii(T.unescape("title")).alias("ascii_title"))


EVIDENCE = """ev AS (SELECT event_id AS seq, event_id // 5 AS subject, user_id % 2 AS profile, CASE WHEN event_type = 'click' THEN '' ELSE 'place ' || (event_id % 2) END AS institution,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 1990 + CAST(event_id % 2 AS INTEGER) END AS year,
  round(least(0.99, 0.95 * (0.55 * greatest(0, least(1, value / 100)) + 0.2 * CASE WHEN user_id % 5 = 0 THEN 1 ELSE greatest(0.35, 1 - 0.15 * (greatest(user_id % 6, 1) - 1)) END
    + CASE WHEN event_type <> 'click' THEN 0.15 ELSE 0 END + CASE WHEN event_id % 3 <> 0 THEN 0.1 ELSE 0 END))::DOUBLE, 9) AS confidence FROM events)"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    place, year = F.col("event_type") != "click", F.col("event_id") % 3 != 0
    score = S.evidence_score(F.col("value") / 100, F.col("user_id") % 6, place, year, F.col("user_id") % 5 == 0, places=9)
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 5).cast("long").alias("subject"), (F.col("user_id") % 2).alias("profile"), F.when(place, F.concat(F.lit("place "), (F.col("event_id") % 2).cast("string"))).otherwise("").alias("institution"), F.when(year, (1990 + F.col("event_id") % 2).cast("int")).alias("year"), score.alias("confidence"))


@query(
    """SELECT event_id, round(least(0.99::DOUBLE, 0.95::DOUBLE * (0.55::DOUBLE * greatest(0, least(1, value / 100)) + 0.2::DOUBLE * CASE WHEN user_id % 5 = 0 THEN 1::DOUBLE ELSE greatest(0.35::DOUBLE, 1::DOUBLE - 0.15::DOUBLE * (greatest(user_id % 6, 1) - 1)) END
  + CASE WHEN event_type <> 'click' THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN event_id % 3 <> 0 THEN 0.1::DOUBLE ELSE 0 END)), 9) AS confidence FROM events"""
)
def evidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = S.evidence_score(F.col("value") / 100, F.col("user_id") % 6, F.col("event_type") != "click", F.col("event_id") % 3 != 0, F.col("user_id") % 5 == 0, places=9)
    return table(spark, sf_dir, "events").select("event_id", score.alias("confidence"))


RESOLVE = """, evd AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY subject, profile, lower(trim(institution)), year ORDER BY confidence DESC, seq) AS rn FROM ev) WHERE rn = 1),
sub AS (SELECT DISTINCT s AS subject, CAST(s % 4 AS INTEGER) AS candidates, s % 11 = 0 AS truncated FROM (SELECT event_id // 5 AS s FROM events UNION SELECT 10000000 + c_custkey FROM customer)),
agg AS (SELECT subject, count(*) AS records, max(confidence) AS any_confidence FROM evd GROUP BY 1),
top AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY confidence DESC, seq) AS rn FROM evd WHERE institution <> '') WHERE rn = 1),
riv AS (SELECT t.subject, max(e.confidence) FILTER (e.profile <> t.profile) AS rival, count(DISTINCT e.institution) FILTER (e.profile = t.profile) AS places, count(DISTINCT e.year) FILTER (e.profile = t.profile) AS years
  FROM top t JOIN evd e ON e.subject = t.subject AND e.institution <> '' GROUP BY 1),
dec AS (SELECT sub.*, records, any_confidence, top.confidence AS c, top.institution AS i, top.year AS yr, CASE
  WHEN top.profile IS NULL AND coalesce(records, 0) > 0 THEN 'record_missing_institution' WHEN top.profile IS NULL AND truncated THEN 'search_truncated_without_match'
  WHEN top.profile IS NULL AND candidates > 0 THEN 'profiles_without_record' WHEN top.profile IS NULL THEN 'no_profile' WHEN places > 1 OR years > 1 THEN 'profile_conflicts'
  WHEN truncated THEN 'search_truncated' WHEN top.confidence - rival < 0.12::DOUBLE THEN 'competing_profiles' WHEN top.confidence < 0.85::DOUBLE THEN 'below_threshold'
  WHEN top.year IS NULL THEN 'year_not_public' ELSE 'clear_record' END AS reason FROM sub LEFT JOIN agg USING (subject) LEFT JOIN top USING (subject) LEFT JOIN riv USING (subject))
SELECT subject, CASE WHEN reason = 'record_missing_institution' THEN 'incomplete_record' WHEN reason IN ('profiles_without_record', 'no_profile') THEN 'not_found' WHEN reason = 'below_threshold' THEN 'low_confidence'
  WHEN reason = 'year_not_public' THEN 'matched_institution_only' WHEN reason = 'clear_record' THEN 'matched_high_confidence' ELSE 'ambiguous' END AS status, reason,
  coalesce(c, any_confidence, 0) AS confidence, CASE WHEN reason IN ('year_not_public', 'clear_record') THEN i ELSE '' END AS institution, CASE WHEN reason IN ('year_not_public', 'clear_record') THEN yr END AS year FROM dec"""


@query("WITH " + EVIDENCE.replace("0.95 *", "0.95::DOUBLE *").replace("(0.55 *", "(0.55::DOUBLE *").replace("0.2 *", "0.2::DOUBLE *").replace("greatest(0.35, 1 - 0.15 *", "greatest(0.35::DOUBLE, 1 - 0.15::DOUBLE *").replace("least(0.99,", "least(0.99::DOUBLE,").replace("THEN 0.15 ", "THEN 0.15::DOUBLE ").replace("THEN 0.1 ", "THEN 0.1::DOUBLE ").replace("))::DOUBLE, 9)", ")), 9)") + RESOLVE)
def evidence_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("subject")
    seen = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 5).cast("long").alias("subject"))
    subjects = seen.union(table(spark, sf_dir, "customer").select(F.col("c_custkey") + 10_000_000)).distinct()
    subjects = subjects.select(s, (s % 4).cast("int").alias("candidates"), (s % 11 == 0).alias("truncated"))
    return S.resolve(_evidence(spark, sf_dir), subjects)


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return S.latest(rows, "user_id", "event_id")


@query("SELECT c_custkey AS user_id, c_name FROM customer WHERE c_custkey > 100 AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def pending_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo = table(spark, sf_dir, "customer").where("c_custkey > 100").select(F.col("c_custkey").alias("user_id"), "c_name")
    return S.pending(todo, table(spark, sf_dir, "events").where("event_type = 'purchase'"), "user_id")


@query(
    """WITH r AS (SELECT c_custkey, concat_ws('; ', CASE WHEN c_acctbal < 0 THEN 'negative balance' END, CASE WHEN c_nationkey > 20 THEN 'far nation' END, CASE WHEN c_custkey % 9 = 0 THEN 'ninth' END) AS review_reasons FROM customer)
SELECT c_custkey, review_reasons FROM r WHERE review_reasons <> ''"""
)
def manual_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = {"negative balance": F.col("c_acctbal") < 0, "far nation": F.col("c_nationkey") > 20, "ninth": F.col("c_custkey") % 9 == 0}
    rows = table(spark, sf_dir, "customer").select("c_custkey", ordered_reasons(reasons).alias("review_reasons"))
    return rows.where("review_reasons <> ''")


def _outcomes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    outcomes = evidence_resolution(spark, sf_dir)
    return S.resolution_rows(outcomes.select("subject"), outcomes.where("subject % 3 <> 0"), _evidence(spark, sf_dir))


def _resolved_sql() -> str:
    from .registry import _SQL

    return _SQL["evidence_resolution"]


@query(f"WITH out AS ({_resolved_sql()}) SELECT subject, CASE WHEN subject % 3 = 0 THEN 'not_processed' ELSE status END AS status, CASE WHEN subject % 3 = 0 OR status IN ('matched_high_confidence', 'matched_institution_only') THEN '' ELSE reason END AS review_reason FROM out")
def resolution_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subject's outcome; those without one are not processed."""
    return _outcomes(spark, sf_dir)[0].select("subject", "status", "review_reason")


@query(
    f"""WITH out AS ({_resolved_sql()}), ev AS (SELECT event_id AS seq, event_id // 5 AS subject, CASE WHEN event_type = 'click' THEN '' ELSE 'place ' || (event_id % 2) END AS institution FROM events)
SELECT subject, status, reason AS review_reason, count(seq) AS candidates, count(*) FILTER (ev.institution <> '') AS with_place FROM out LEFT JOIN ev USING (subject) WHERE subject % 3 <> 0 AND status NOT IN ('matched_high_confidence', 'matched_institution_only') GROUP BY ALL"""
)
def resolution_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates each subject shows for review."""
    rows = _outcomes(spark, sf_dir)[1]
    return rows.groupBy("subject", "status", "review_reason").agg(F.count_if(F.col("candidate_rank") > 0).alias("candidates"), F.count_if(F.col("candidate_institution") != "").alias("with_place"))
