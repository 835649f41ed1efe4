"""Ensemble, tuning and assembly queries; hashes of ids stand in for classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import split_cell
from ..functions.scratch import Scratch
from ..operators import classify as C
from ..operators import ensemble as E
from ..operators import jointfit as J
from ..operators import linkage as L
from .facts import table
from .registry import query

MODELS = ["tfidf", "plain", "deep"]
LABELS = ["A", "B", "C"]
OPTIONS = {"tfidf": [1.0, 1.5, 2.0, 2.5], "plain": [1.0], "deep": [1.0, 1.5, 2.0, 2.5]}
# Each model's cell: two letters that depend on the order, and a confidence.
PRED = """pr AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'A; B' WHEN 1 THEN 'B' ELSE 'C' END AS truth,
  CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'A; B' WHEN 2 THEN 'C' ELSE '' END AS tfidf_prediction, (o_orderkey % 10) / 10.0 AS tfidf_confidence, CASE o_orderkey % 5 WHEN 0 THEN 'A; B' WHEN 1 THEN 'B' WHEN 2 THEN 'B; C' WHEN 3 THEN 'C' ELSE '' END AS plain_prediction, (o_orderkey % 7) / 7.0 AS plain_confidence,
  CASE o_orderkey % 6 WHEN 0 THEN 'A; B' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'A' WHEN 4 THEN 'B; C' ELSE 'C' END AS deep_prediction, (o_orderkey % 9) / 9.0 AS deep_confidence FROM orders)"""
GRID = f"""{PRED}, wt AS (SELECT CAST(row_number() OVER (ORDER BY t, d) AS INTEGER) AS config, t, d FROM (SELECT unnest([1.0, 1.5, 2.0, 2.5]) AS t) CROSS JOIN (SELECT unnest([1.0, 1.5, 2.0, 2.5]) AS d)),
vo AS (SELECT id, m, trim(unnest(string_split(cell, ';'))) AS label, conf FROM (SELECT id, 'tfidf' AS m, tfidf_prediction AS cell, tfidf_confidence::DOUBLE AS conf FROM pr UNION ALL SELECT id, 'plain', plain_prediction, plain_confidence::DOUBLE FROM pr UNION ALL SELECT id, 'deep', deep_prediction, deep_confidence::DOUBLE FROM pr) WHERE cell <> ''),
wv AS (SELECT config, id, m, label, conf, CASE m WHEN 'tfidf' THEN t WHEN 'deep' THEN d ELSE 1.0 END::DOUBLE AS w FROM vo CROSS JOIN wt),
su AS (SELECT config, id, label, sum(w) AS w, sum(w * conf) AS c FROM wv GROUP BY ALL HAVING sum(w) >= 2), wo AS (SELECT config, id, string_agg(label, '; ' ORDER BY label) AS labels, avg(c / w) AS confidence FROM su GROUP BY ALL),
mo AS (SELECT config, id, m, max(conf) AS conf, count(*) AS n, string_agg(label, '; ' ORDER BY label) AS txt FROM wv GROUP BY ALL), be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config, id ORDER BY conf DESC, n DESC, txt DESC) AS rn FROM mo) WHERE rn = 1),
ens AS (SELECT config, id, coalesce(labels, txt) AS labels, coalesce(confidence, conf) AS confidence FROM be LEFT JOIN wo USING (config, id))"""


def _cells(key: F.Column, values: list[str]) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


def _predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[DataFrame]]:
    """``(truth, [one table a model])`` with ``id`` in each."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", key.alias("id"))
    truth = orders.select("id", _cells(key, ["A; B", "B", "C"]).alias("truth"))
    cells = {"tfidf": (["A", "A; B", "C", ""], 10), "plain": (["A; B", "B", "B; C", "C", ""], 7), "deep": (["A; B", "B", "C", "A", "B; C", "C"], 9)}
    return truth, [orders.select("id", _cells(key, v).alias(f"{m}_prediction"), ((key % n) / F.lit(float(n))).alias(f"{m}_confidence")) for m, (v, n) in cells.items()]


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, models = _predictions(spark, sf_dir)
    return L.inner_on_all([truth, *models], ["id"])


METRIC_SQL = """lb AS (SELECT unnest(['A', 'B', 'C']) AS label), mx AS (SELECT {key}, id, label, list_contains(string_split(truth, '; '), label)::INT AS t, list_contains(string_split(labels, '; '), label)::INT AS p FROM src CROSS JOIN lb),
pl AS (SELECT {key}, label, sum(t * p) AS tp, sum((1 - t) * p) AS fp, sum(t * (1 - p)) AS fn, count(*) AS n FROM mx GROUP BY ALL), ex AS (SELECT {key}, avg(w) AS subset_accuracy FROM (SELECT {key}, id, min((t = p)::INT) AS w FROM mx GROUP BY ALL) GROUP BY ALL),
mt AS (SELECT {key}, coalesce(sum(tp) / nullif(sum(tp + fp), 0), 0) AS micro_precision, coalesce(sum(tp) / nullif(sum(tp + fn), 0), 0) AS micro_recall, coalesce(2 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0), 0) AS micro_f1,
  avg(coalesce(tp / nullif(tp + fp, 0), 0)) AS macro_precision, avg(coalesce(tp / nullif(tp + fn, 0), 0)) AS macro_recall, avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS macro_f1, sum(fp + fn) / sum(n) AS hamming_loss FROM pl GROUP BY ALL)"""
NAMES = ["micro_precision", "micro_recall", "micro_f1", "macro_precision", "macro_recall", "macro_f1", "hamming_loss", "subset_accuracy"]
ROUNDED = ", ".join(f"round({c}, 9) AS {c}" for c in NAMES)


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(c, 9).alias(c) for c in NAMES])


@query(f"WITH {GRID} SELECT config, id AS row, labels, round(confidence, 9) AS confidence FROM ens")
def ensemble_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted votes of three models for all sixteen weight pairs; the models' tables joined on a unique key."""
    rows = _joined(spark, sf_dir).select(F.col("id").alias("row"), E.row_votes(MODELS).alias("votes"))
    out = E.weighted_rows(rows, "votes", E.weight_grid(spark, OPTIONS))
    return out.select("config", "row", F.array_join("chosen", "; ").alias("labels"), F.round("confidence", 9).alias("confidence"))


@query(f"WITH {GRID}, src AS (SELECT config, id, truth, labels FROM ens JOIN pr USING (id)), {METRIC_SQL.format(key='config')} SELECT config, {ROUNDED} FROM mt JOIN ex USING (config)")
def ensemble_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.grid_metrics(_joined(spark, sf_dir), "id", "truth", MODELS, E.weight_grid(spark, OPTIONS), LABELS), "config")


@query(f"WITH {PRED}, src AS (SELECT 'tfidf' AS model, id, truth, tfidf_prediction AS labels FROM pr UNION ALL SELECT 'plain', id, truth, plain_prediction FROM pr UNION ALL SELECT 'deep', id, truth, deep_prediction FROM pr), {METRIC_SQL.format(key='model')} SELECT model, {ROUNDED} FROM mt JOIN ex USING (model)")
def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.model_metrics(_joined(spark, sf_dir), "id", "truth", MODELS, LABELS), "model")


@query(f"WITH {PRED} SELECT id, tfidf_prediction, plain_prediction, deep_prediction FROM pr")
def zipped_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction files side by side by row position, their row counts asserted."""
    _, models = _predictions(spark, sf_dir)
    tables = {m: t.select("id", F.col(f"{m}_prediction").alias("prediction")) for m, t in zip(MODELS, models, strict=True)}
    return L.zip_by_position(tables, "id")


@query(f"WITH {PRED} SELECT id, CASE WHEN id % 2 = 0 THEN truth ELSE '' END AS label, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS label_observed, CASE WHEN id % 2 = 0 THEN truth ELSE tfidf_prediction END AS tfidf_label, CASE WHEN id % 2 = 0 THEN truth ELSE deep_prediction END AS deep_label FROM pr")
def complete_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed labels, else each model's."""
    truth, (tfidf, _, deep) = _predictions(spark, sf_dir)
    observed = truth.select("id", F.when(F.col("id") % 2 == 0, F.col("truth")).otherwise("").alias("label"))
    rest = {m: t.where("id % 2 = 1").select("id", F.col(f"{m}_prediction").alias("label")) for m, t in (("tfidf", tfidf), ("deep", deep))}
    return E.complete_table(observed, rest, "id", "label")


@query(
    """WITH s AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('2026-' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN r <= CASE WHEN n < 2 THEN 0 ELSE greatest(1, floor(n * 0.2::DOUBLE + 0.5::DOUBLE)) END THEN 'test' ELSE 'train' END AS part FROM s"""
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.stratified_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query(
    f"""WITH {PRED}, fo AS (SELECT *, id % 4 AS fold FROM pr), cf AS (SELECT unnest([0, 1, 2]) AS config), src AS (SELECT config * 10 + fold AS key, id, truth, CASE config WHEN 0 THEN tfidf_prediction WHEN 1 THEN plain_prediction ELSE deep_prediction END AS labels FROM fo CROSS JOIN cf), {METRIC_SQL.format(key='key')},
al AS (SELECT CAST(key // 10 AS INTEGER) AS config, * FROM mt JOIN ex USING (key)), ag AS (SELECT config, avg(micro_f1) AS micro_f1, stddev_pop(micro_f1) AS std_micro_f1, avg(macro_f1) AS macro_f1, avg(micro_precision) AS mp, avg(micro_recall) AS mr, avg(hamming_loss) AS hamming_loss, stddev_pop(hamming_loss) AS std_hamming_loss, avg(subset_accuracy) AS sa, count(*) AS folds FROM al GROUP BY 1)
SELECT config, CAST(row_number() OVER (ORDER BY micro_f1 DESC, macro_f1 DESC, mp DESC, mr DESC, hamming_loss, sa DESC, config) AS INTEGER) AS rank, round(micro_f1, 9) AS micro_f1, round(std_micro_f1, 9) AS std_micro_f1, round(hamming_loss, 9) AS hamming_loss, round(std_hamming_loss, 9) AS std_hamming_loss, folds FROM ag"""
)
def tuning_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three settings measured on four folds, ranked metric by metric; a setting is a model's own predictions here."""
    joined = Scratch(spark, "tuning").kept(_joined(spark, sf_dir).withColumn("fold", (F.col("id") % 4).cast("int")))  # read for each setting and fold

    def predictions(train: DataFrame, test: DataFrame, setting: dict[str, str]) -> DataFrame:
        return test.select(split_cell(F.col("truth")).alias("truth"), split_cell(F.col(f"{setting['model']}_prediction")).alias("predicted"))

    def measure(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
        return C.cell_metrics(rows, "truth", "predicted", LABELS, by)

    out = E.grid_search(joined, [{"model": m} for m in MODELS], predictions, 4, measure)
    return out.select("config", "rank", *[F.round(c, 9).alias(c) for c in ("micro_f1", "std_micro_f1", "hamming_loss", "std_hamming_loss")], "folds")


@query()
def regularisation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid search over the strength of a logistic regression on scaled embeddings, in three folds that are fitted together; without SQL."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), "embedding", (F.col("label") == 3).cast("int").alias("is_3"), F.pmod(F.xxhash64("vec_id"), F.lit(3)).cast("int").alias("fold"))
    data, width = J.scaled(rows, "embedding")
    strengths = [0.01, 1.0]
    scores = J.predict_all(data, J.fit_all(data, width, ["is_3"], [0, 1, 2], strengths), ["is_3"])
    parts = [C.metrics(C.chosen(scores.where(F.col("strength") == x), 0.5).withColumn("config", F.lit(i)), ("config", "fold")) for i, x in enumerate(strengths)]
    return E.fold_table(parts[0].unionByName(parts[1]), ["config"])


@query()
def softmax_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multinomial classifier of the embeddings' label, tested on a fifth of the rows; fitted, so without SQL."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.col("label").cast("int").alias("label"))
    split = E.stratified_split(C.scaled_vectors(rows, "embedding").drop("embedding"), "label", "row").cache()
    model = C.softmax_classifier(split.where("part = 'train'"), "label", regularisation=0.01, iterations=15)
    return C.predict_class(model, split.where("part = 'test'"), "row", "label")


@query(
    """WITH p AS (SELECT o_orderkey, o_orderkey % 4 AS truth, o_orderkey % 3 AS predicted FROM orders), c AS (SELECT unnest([0, 1, 2, 3]) AS class)
SELECT CAST(class AS INTEGER) AS class, round(coalesce(tp / nullif(said, 0), 0), 9) AS precision, round(coalesce(tp / nullif(support, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(said + support, 0), 0), 9) AS f1, support, round(acc, 9) AS accuracy
FROM (SELECT class, count(*) FILTER (truth = class AND predicted = class) AS tp, count(*) FILTER (predicted = class) AS said, count(*) FILTER (truth = class) AS support, avg((truth = predicted)::INT) AS acc FROM p CROSS JOIN c GROUP BY class)"""
)
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    out = C.report(table(spark, sf_dir, "orders").select(key.alias("row"), (key % 4).cast("int").alias("truth"), (key % 3).cast("int").alias("predicted")))
    return out.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support", F.round("accuracy", 9).alias("accuracy"))
