"""Classification queries over the document labels, and their models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import Scratch
from ..operators import classify as C
from ..operators import jointfit as J
from ..operators import terms as T
from .facts import table
from .registry import query

# A prediction table that both engines can make: scores from digests of ids, leaning to the truth.
SCORES = """sc AS (SELECT doc_id AS row, label, truth, round((truth * 3 + ('0x' || substr(md5(label || '-' || CAST(doc_id AS VARCHAR)), 1, 6))::BIGINT % 1000 / 200.0::DOUBLE) / 8, 6) AS score
  FROM (SELECT doc_id, 'quality' AS label, quality AS truth FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels))"""
PICK = """pk AS (SELECT *, CASE WHEN max((score >= {t})::INT) OVER (PARTITION BY {by} row) = 1 THEN (score >= {t})::INT
  ELSE (row_number() OVER (PARTITION BY {by} row ORDER BY score DESC, label) = 1)::INT END AS predicted FROM {src})"""
METRICS = """per AS (SELECT {by} label, count(*) FILTER (truth = 1 AND predicted = 1) AS tp, count(*) FILTER (truth = 0 AND predicted = 1) AS fp, count(*) FILTER (truth = 1 AND predicted = 0) AS fn, count(*) AS n FROM pk GROUP BY ALL),
lab AS (SELECT {by} sum(tp) / sum(tp + fp) AS micro_precision, sum(tp) / sum(tp + fn) AS micro_recall, 2 * sum(tp) / sum(2 * tp + fp + fn) AS micro_f1,
  avg(coalesce(tp / nullif(tp + fp, 0), 0)) AS macro_precision, avg(coalesce(tp / nullif(tp + fn, 0), 0)) AS macro_recall, avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS macro_f1, sum(fp + fn) / sum(n) AS hamming_loss FROM per {group}),
ex AS (SELECT {by} avg(w) AS subset_accuracy FROM (SELECT {by} row, min((truth = predicted)::INT) AS w FROM pk GROUP BY ALL) {group})
SELECT {by} round(micro_precision, 9) AS micro_precision, round(micro_recall, 9) AS micro_recall, round(micro_f1, 9) AS micro_f1, round(macro_precision, 9) AS macro_precision, round(macro_recall, 9) AS macro_recall, round(macro_f1, 9) AS macro_f1,
  round(hamming_loss, 9) AS hamming_loss, round(subset_accuracy, 9) AS subset_accuracy FROM lab {join}"""
THRESHOLDS = [0.3, 0.4, 0.5, 0.6]


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row"), F.explode(F.create_map(F.lit("quality"), F.col("quality"), F.lit("toxic"), F.col("toxic"))).alias("label", "truth"))
    digest = F.conv(F.substring(F.md5(F.concat_ws("-", "label", F.col("row").cast("string"))), 1, 6), 16, 10).cast("long")
    return rows.withColumn("score", F.round((F.col("truth") * 3 + digest % 1000 / F.lit(200.0)) / 8, 6))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c, kind in df.dtypes if kind == "double" and c != "threshold"})


@query(f"WITH {SCORES}, {PICK.format(t='0.5::DOUBLE', by='', src='sc')}, " + METRICS.format(by="", group="", join=", ex"))
def multilabel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.metrics(C.chosen(_scores(spark, sf_dir), 0.5)))


SWEEP = f"WITH {SCORES}, th AS (SELECT sc.*, v.t::DOUBLE AS threshold FROM sc, (VALUES {', '.join(f'({t})' for t in THRESHOLDS)}) v(t)), "
SWEEP += PICK.format(t="threshold", by="threshold,", src="th") + ", " + METRICS.format(by="threshold,", group="GROUP BY threshold", join="JOIN ex USING (threshold)")


@query(SWEEP)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.threshold_sweep(_scores(spark, sf_dir), THRESHOLDS))


@query(f"WITH s AS ({SWEEP}) SELECT threshold, micro_f1, macro_f1 FROM s ORDER BY micro_f1 DESC, macro_f1 DESC, hamming_loss, threshold LIMIT 1")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best configuration by lexicographic metrics (a top-1 report)."""
    results = _rounded(C.threshold_sweep(_scores(spark, sf_dir), THRESHOLDS))
    return C.best_config(results, "threshold", [F.desc("micro_f1"), F.desc("macro_f1"), F.asc("hamming_loss")]).select("threshold", "micro_f1", "macro_f1")


@query(f"WITH {SCORES} SELECT label, truth, (score >= 0.5::DOUBLE)::INT AS predicted, count(*) AS n FROM sc GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return rows.groupBy("label", "truth", "predicted").agg(F.count("*").alias("n"))


VOTES = """vt AS (SELECT doc_id AS row, model, substr('ABCDEF', 1 + CAST(('0x' || substr(md5(model || CAST(doc_id AS VARCHAR)), 1, 4))::BIGINT % 6 AS INTEGER), 1) AS label, weight, round((('0x' || substr(md5(model || CAST(doc_id AS VARCHAR)), 5, 4))::BIGINT % 100) / 100.0::DOUBLE, 2) AS confidence
  FROM labels, (VALUES ('m1', 1.0::DOUBLE), ('m2', 1.0::DOUBLE), ('m3', 2.5::DOUBLE)) v(model, weight))"""


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(w).alias("weight")) for m, w in (("m1", 1.0), ("m2", 1.0), ("m3", 2.5))])
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row"), F.explode(models).alias("v")).select("row", "v.model", "v.weight")
    digest = F.md5(F.concat("model", F.col("row").cast("string")))

    def part(at: int, of: int) -> Column:
        return F.conv(F.substring(digest, at, 4), 16, 10).cast("long") % of

    return rows.select("row", "model", F.substr(F.lit("ABCDEF"), (part(1, 6) + 1).cast("int"), F.lit(1)).alias("label"), "weight", F.round(part(5, 100) / F.lit(100.0), 2).alias("confidence"))


@query(
    f"""WITH {VOTES}, s AS (SELECT row, label, sum(weight) AS weight, sum(confidence) AS confidence FROM vt GROUP BY ALL)
SELECT row, label, weight, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY weight DESC, confidence DESC, label) AS rn FROM s) WHERE rn = 1"""
)
def weighted_vote_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.vote_single(_votes(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(
    f"""WITH {VOTES}, v AS (SELECT row, model, label, CASE WHEN model = 'm3' THEN 1.5::DOUBLE ELSE weight END AS weight, confidence FROM vt),
s AS (SELECT row, label FROM v GROUP BY ALL HAVING sum(weight) >= 2), w AS (SELECT row, string_agg(label, '; ' ORDER BY label) AS labels FROM s GROUP BY row),
m AS (SELECT row, model, max(confidence) AS c, count(*) AS n, string_agg(label, '; ' ORDER BY label) AS t FROM v GROUP BY ALL),
b AS (SELECT row, t AS fallback FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY c DESC, n DESC, t DESC) AS rn FROM m) WHERE rn = 1)
SELECT row, coalesce(labels, fallback) AS labels, CASE WHEN labels IS NULL THEN 'best model' ELSE 'vote' END AS how FROM b LEFT JOIN w USING (row)"""
)
def weighted_vote_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = _votes(spark, sf_dir).withColumn("weight", F.when(F.col("model") == "m3", 1.5).otherwise(F.col("weight")))
    return C.vote_multi(votes)


@query("SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5('fold-' || CAST(doc_id AS VARCHAR))) - 1) % 5 AS INTEGER) AS fold FROM labels")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.folds(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", 5)


@query("WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1) SELECT quality, n, round(sum(n) OVER () / (count(*) OVER () * n), 9) AS weight FROM c")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.balanced_weights(table(spark, sf_dir, "labels").select("quality"), "quality")
    return rows.groupBy("quality").agg(F.count("*").alias("n"), F.round(F.first("weight"), 9).alias("weight"))


@query("SELECT doc_id, quality AS has_quality, toxic AS has_toxic FROM labels")
def one_hot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.columns import one_hot

    names = F.filter(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull())
    return one_hot(table(spark, sf_dir, "labels").select("doc_id", names.alias("labels")), "labels", ["quality", "toxic"]).drop("labels")


@query()
def tfidf_multilabel_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold label scores from word n-grams, in five folds or as many as the smaller class has rows; fitted, so without SQL."""
    labels = ["quality", "toxic"]
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id")
    sizes = [r["count"] for r in rows.groupBy("quality").count().collect()]  # a row a class
    k = max(2, min(5, *sizes)) if sizes else 2
    vectors, terms = T.tfidf_arrays(rows, "doc_id", "text", n=2, vocabulary=50_000)
    folded = C.folds(rows, "quality", "doc_id", k).select(F.col("doc_id").alias("row"), "fold", *labels)
    data = Scratch(spark, "tfidf").kept(vectors.join(folded, "row"))  # read to fit and to score
    fitted = J.fit_all(data, terms.count(), labels, list(range(k)), [1.0 / max(1, sum(sizes))])
    return C.chosen(J.predict_all(data, fitted, labels).select("row", "label", "truth", "score"), 0.5)


@query()
def embedding_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of one label from scaled embeddings, in five hashed folds; fitted, so without SQL."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), "embedding", (F.col("label") == 3).cast("int").alias("is_3"), F.pmod(F.xxhash64("vec_id"), F.lit(5)).cast("int").alias("fold"))
    data, width = J.scaled(rows, "embedding")
    fitted = J.fit_all(data, width, ["is_3"], list(range(5)), [0.01])
    return J.predict_all(data, fitted, ["is_3"]).select(F.col("row").alias("vec_id"), "label", "truth", "score")


@query(
    """WITH x AS (SELECT vec_id // 4 AS doc, list_transform(embedding, lambda e: e::DOUBLE) AS v, vec_id % 4 AS pos FROM embeddings)
SELECT doc, CAST(i AS INTEGER) AS place, round(avg(v[i]), 9) AS mean FROM x, unnest(range(1, len(v) + 1)) AS t(i) WHERE pos <> 3 GROUP BY doc, i"""
)
def masked_mean_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the token vectors whose mask is 1, all of it, by place; four vectors stand in for a document's tokens."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).cast("long").alias("doc"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), (F.col("vec_id") % 4 != 3).cast("int").alias("m"), "vec_id")
    docs = rows.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v", "m"))).alias("t"))
    mean = C.masked_mean(F.transform("t", lambda x: x["v"]), F.transform("t", lambda x: x["m"]))
    return docs.select("doc", F.posexplode(mean).alias("place", "mean")).select("doc", (F.col("place") + 1).alias("place"), F.round("mean", 9).alias("mean"))
