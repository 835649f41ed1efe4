"""Multi-label classification: features, models, thresholds, metrics and votes.

Predictions are long tables ``(row, label, truth, score)``; every metric is one aggregation of it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, StandardScaler, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import hash_ranks


#: The columns of :func:`metrics` after its keys.
METRICS = ["micro_precision", "micro_recall", "micro_f1", "macro_precision", "macro_recall", "macro_f1", "hamming_loss", "subset_accuracy"]


def tfidf(texts: DataFrame, text: str, n: int = 2, min_df: int = 2, max_df: float = 0.9, vocabulary: int = 20_000) -> tuple[DataFrame, PipelineModel]:
    """``features``: word 1..n-grams; counts ``1 + ln(tf)``, weights ``ln((N + 1) / (df + 1)) + 1``, unit length."""
    stages = [RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"), StopWordsRemover(inputCol="_words", outputCol="_g1")]
    stages += [NGram(n=k, inputCol="_g1", outputCol=f"_g{k}") for k in range(2, n + 1)]
    grams = Pipeline(stages=stages).fit(texts).transform(texts)
    grams = grams.withColumn("_grams", F.concat(*[f"_g{k}" for k in range(1, n + 1)]))
    model = Pipeline(stages=[CountVectorizer(inputCol="_grams", outputCol="_tf", minDF=min_df, maxDF=max_df, vocabSize=vocabulary), IDF(inputCol="_tf", outputCol="_idf")]).fit(grams)
    idf = model.stages[-1].idf.toArray()  # at most ``vocabulary`` numbers
    rows = model.transform(grams)
    weigh = _sublinear(idf)
    out = Normalizer(inputCol="_weighted", outputCol="features").transform(rows.withColumn("_weighted", weigh("_tf")))
    return out.drop("_words", *[f"_g{k}" for k in range(1, n + 1)], "_grams", "_tf", "_idf", "_weighted"), model


def _sublinear(idf: np.ndarray) -> Callable[[str], Column]:
    """The weighted vector of a count vector: ``(1 + ln(tf)) * (idf + 1)``."""

    @F.udf(VectorUDT())
    def weigh(tf: SparseVector) -> SparseVector:
        return SparseVector(tf.size, tf.indices, (1.0 + np.log(tf.values)) * (idf[tf.indices] + 1.0))

    return weigh


def scaled_vectors(df: DataFrame, array: str) -> DataFrame:
    """``features``: an array column as a vector of zero means and unit deviations."""
    vectors = df.withColumn("_v", array_to_vector(F.col(array)))
    return StandardScaler(inputCol="_v", outputCol="features", withMean=True, withStd=True).fit(vectors).transform(vectors).drop("_v")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight n / (classes * size of the class)."""
    n = Window.partitionBy()
    sizes = df.groupBy(label).agg(F.count("*").alias("_c"))
    sizes = sizes.select(label, (F.sum("_c").over(n) / (F.count("*").over(n) * F.col("_c"))).alias("weight"))  # one row a class
    return df.join(F.broadcast(sizes), label)


def one_vs_rest(train: DataFrame, labels: list[str], regularisation: float = 0.0, iterations: int = 50) -> dict[str, object]:
    """A binary logistic regression for each label column (0/1)."""
    out = {}
    for label in labels:
        weighted = balanced_weights(train, label)
        out[label] = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", maxIter=iterations, regParam=regularisation, tol=1e-6).fit(weighted)
    return out


def predict(models: dict[str, object], df: DataFrame, row: str) -> DataFrame:
    """``row, label, truth, score`` for each row and label."""
    parts = []
    for label, model in models.items():
        scored = model.transform(df).select(row, F.lit(label).alias("label"), F.col(label).cast("int").alias("truth"), F.get(vector_to_array("probability"), 1).alias("score"))
        parts.append(scored)
    return reduce(DataFrame.union, parts)


def folds(df: DataFrame, stratum: str, key: str, k: int) -> DataFrame:
    """``fold``: rows of each stratum dealt round in the order of a seeded hash of their key."""
    ranked = hash_ranks(df, stratum, F.md5(F.concat(F.lit("fold-"), F.col(key).cast("string"))), [key], "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def out_of_fold(df: DataFrame, labels: list[str], row: str, k: int, regularisation: float = 0.0) -> DataFrame:
    """Predictions for each fold by models of the others; ``df`` has ``fold`` and ``features``."""
    parts = [predict(one_vs_rest(df.where(F.col("fold") != i), labels, regularisation), df.where(F.col("fold") == i), row) for i in range(k)]
    return reduce(DataFrame.union, parts)


def chosen(scores: DataFrame, threshold: Column | float) -> DataFrame:
    """``predicted``: the labels at or above the threshold, else the best one (ties to the smaller label)."""
    part = Window.partitionBy("row")
    any_ = F.max((F.col("score") >= threshold).cast("int")).over(part)
    best = F.row_number().over(part.orderBy(F.desc("score"), "label"))
    return scores.withColumn("predicted", F.when(any_ == 1, (F.col("score") >= threshold).cast("int")).otherwise((best == 1).cast("int")))


def metrics(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Micro and macro precision, recall and F1, Hamming loss and subset accuracy of ``(row, label, truth, predicted)``."""
    t, p = F.col("truth") == 1, F.col("predicted") == 1
    per = predictions.groupBy(*by, "label").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count("*").alias("n"))
    labels = _label_metrics(per, by)
    exact = predictions.groupBy(*by, "row").agg(F.min((F.col("truth") == F.col("predicted")).cast("int")).alias("whole")).groupBy(*by).agg(F.avg("whole").alias("subset_accuracy"))
    return labels.join(exact, list(by)) if by else labels.crossJoin(exact)  # one row each


def _label_metrics(per: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The metrics of each label's counts ``label, tp, fp, fn, n``."""

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return per.groupBy(*by).agg(
        ratio(F.sum(tp), F.sum(tp + fp)).alias("micro_precision"),
        ratio(F.sum(tp), F.sum(tp + fn)).alias("micro_recall"),
        ratio(2 * F.sum(tp), F.sum(2 * tp + fp + fn)).alias("micro_f1"),
        F.avg(ratio(tp, tp + fp)).alias("macro_precision"),
        F.avg(ratio(tp, tp + fn)).alias("macro_recall"),
        F.avg(ratio(2 * tp, 2 * tp + fp + fn)).alias("macro_f1"),
        (F.sum(fp + fn) / F.sum("n")).alias("hamming_loss"),
    )


def cell_metrics(rows: DataFrame, truth: str, predicted: str, labels: list[str], by: tuple[str, ...]) -> DataFrame:
    """:func:`metrics` of rows with arrays of true and predicted labels, of which ``labels`` count: rows are counted where they are."""
    cells = rows.select(*by, *[F.array_contains(c, x).alias(f"{k}{i}") for k, c in (("t", truth), ("p", predicted)) for i, x in enumerate(labels)])
    places = range(len(labels))
    aggs = []
    for i in places:
        t, p = F.col(f"t{i}"), F.col(f"p{i}")
        aggs += [F.count_if(t & p).alias(f"tp{i}"), F.count_if(~t & p).alias(f"fp{i}"), F.count_if(t & ~p).alias(f"fn{i}")]
    whole = reduce(lambda a, b: a & b, [F.col(f"t{i}") == F.col(f"p{i}") for i in places])
    counts = cells.groupBy(*by).agg(*aggs, F.count_if(whole).alias("whole"), F.count("*").alias("n"))  # a row a key
    per = F.array(*[F.struct(F.lit(x).alias("label"), *[F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn")]) for i, x in enumerate(labels)])
    long = counts.select(*by, (F.col("whole") / F.col("n")).alias("subset_accuracy"), "n", F.explode(per).alias("l")).select(*by, "subset_accuracy", "n", "l.*")
    return _label_metrics(long, (*by, "subset_accuracy")).select(*by, *METRICS)


def threshold_sweep(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """The metrics of every threshold."""
    each = scores.select("*", F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold"))
    part = Window.partitionBy("threshold", "row")
    over = F.col("score") >= F.col("threshold")
    any_ = F.max(over.cast("int")).over(part)
    best = F.row_number().over(part.orderBy(F.desc("score"), "label"))
    return metrics(each.withColumn("predicted", F.when(any_ == 1, over.cast("int")).otherwise((best == 1).cast("int"))), ("threshold",))


def best_config(results: DataFrame, config: str, order: list[Column]) -> DataFrame:
    """The configuration whose metrics come first lexicographically."""
    return results.orderBy(*order, F.col(config)).limit(1)


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts of (truth, predicted)."""
    return rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def vote_single(votes: DataFrame) -> DataFrame:
    """The label with the most weight in ``(row, label, weight, confidence)``; ties by confidence sum, then smaller label."""
    sums = votes.groupBy("row", "label").agg(F.sum("weight").alias("weight"), F.sum("confidence").alias("confidence"))
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("weight"), F.desc("confidence"), "label"))
    return sums.withColumn("_r", place).where("_r = 1").drop("_r")


def vote_multi(votes: DataFrame, least: float = 2.0) -> DataFrame:
    """Labels whose weights in ``(row, model, label, weight, confidence)`` reach ``least``; a row without any
    takes all labels of the model with the most (confidence, labels, text)."""
    sums = votes.groupBy("row", "label").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= least)
    won = sums.groupBy("row").agg(F.array_join(F.sort_array(F.collect_list("label")), "; ").alias("labels"), F.lit("vote").alias("how"))
    models = votes.groupBy("row", "model").agg(F.max("confidence").alias("c"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("label")), "; ").alias("text"))
    best = models.groupBy("row").agg(F.max(F.struct("c", "n", "text"))["text"].alias("fallback"))
    out = best.join(won, "row", "left")
    return out.select("row", F.coalesce("labels", "fallback").alias("labels"), F.coalesce("how", F.lit("best model")).alias("how"))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors (array of arrays) whose mask is 1."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    total = F.aggregate(kept, F.transform(F.get(vectors, 0), lambda _: F.lit(0.0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def softmax_classifier(train: DataFrame, label: str, regularisation: float = 0.0, iterations: int = 50) -> object:
    """A multinomial logistic regression of one label with any number of classes, weighted by class balance."""
    weighted = balanced_weights(train, label)
    return LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", family="multinomial", maxIter=iterations, regParam=regularisation, tol=1e-6).fit(weighted)


def predict_class(model: object, df: DataFrame, row: str, label: str) -> DataFrame:
    """``row, truth, predicted, confidence``: the likeliest class and its probability."""
    scored = model.transform(df)
    return scored.select(F.col(row).alias("row"), F.col(label).cast("int").alias("truth"), F.col("prediction").cast("int").alias("predicted"), F.array_max(vector_to_array("probability")).alias("confidence"))


def report(predictions: DataFrame) -> DataFrame:
    """``class, precision, recall, f1, support`` of ``(row, truth, predicted)``, and accuracy on every row."""
    cells = predictions.groupBy("truth", "predicted").agg(F.count("*").alias("n"))  # classes squared
    total = cells.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("right"))
    true = cells.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    said = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("said"))
    rows = true.join(said, "class", "full").na.fill(0).crossJoin(F.broadcast(total))  # one row
    precision, recall = F.coalesce(F.try_divide("tp", "said"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("said") + F.col("support")), F.lit(0.0))
    return rows.select("class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", (F.col("right") / F.col("all")).alias("accuracy"))
