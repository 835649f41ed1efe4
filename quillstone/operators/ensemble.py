"""Ensembles of classifiers: joined predictions, weight grids, tuning tables, complete tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product
from operator import add, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import blank, split_cell
from .classify import cell_metrics, metrics
from .ranking import hash_ranks

#: The order in which tuning results are compared; a smaller Hamming loss is better.
TUNING_ORDER = [("micro_f1", False), ("macro_f1", False), ("micro_precision", False), ("micro_recall", False), ("hamming_loss", True), ("subset_accuracy", False)]


def weight_grid(spark: SparkSession, options: dict[str, list[float]]) -> DataFrame:
    """``config, model, weight``: all combinations of the models' weights, numbered from 1."""
    rows = [(i, m, float(w)) for i, combo in enumerate(product(*options.values()), 1) for m, w in zip(options, combo, strict=True)]
    return spark.createDataFrame(rows, "config int, model string, weight double")


def row_votes(models: list[str]) -> Column:
    """A row's votes, an array of ``model, label, confidence``, of columns ``<model>_prediction`` (delimited) and ``<model>_confidence``."""

    def own(m: str) -> Column:
        confidence = F.coalesce(F.col(f"{m}_confidence").cast("double"), F.lit(0.0)).alias("confidence")
        return F.transform(split_cell(F.col(f"{m}_prediction"), distinct=True), lambda x: F.struct(F.lit(m).alias("model"), x.alias("label"), confidence))

    return F.concat(*[own(m) for m in models])


def long_votes(joined: DataFrame, row: str, models: list[str]) -> DataFrame:
    """``row, model, label, confidence``: :func:`row_votes`, one a row."""
    return joined.select(F.col(row).alias("row"), F.explode(row_votes(models)).alias("v")).select("row", "v.*")


def weighted_rows(rows: DataFrame, votes: str, weights: DataFrame, least: float = 2.0) -> DataFrame:
    """:func:`weighted_labels` of rows that have all their votes in an array column: nothing is shuffled.

    The other columns stay; ``config``, ``chosen`` (an array of labels) and ``confidence`` replace ``votes``.  A row has a row
    for each configuration that weighs one of its votes.
    """
    grid: dict[int, dict[str, float]] = {}
    for r in weights.collect():  # few rows
        grid.setdefault(r["config"], {})[r["model"]] = r["weight"]
    models = sorted({m for own in grid.values() for m in own})
    kept = [c for c in rows.columns if c != votes]

    def mine(m: str) -> Column:
        return F.filter(votes, lambda v: v["model"] == m)

    def labelled(label: Column) -> Column:
        """A label with each model's number of votes for it and their confidences' sum."""
        own = [F.filter(f"_{i}", lambda v: v["label"] == label) for i in range(len(models))]
        cells = [F.struct(F.size(x).cast("double").alias("n"), F.aggregate(x, F.lit(0.0), lambda a, v: a + F.coalesce(v["confidence"], F.lit(0.0))).alias("c")) for x in own]
        return F.struct(label.alias("label"), *[x.alias(f"m{i}") for i, x in enumerate(cells)])

    def model_best(i: int) -> Column:
        """What a model alone gives, compared by confidence, number of labels and text."""
        labels = F.sort_array(F.transform(f"_{i}", lambda v: v["label"]))
        best = F.struct(F.array_max(F.transform(f"_{i}", lambda v: v["confidence"])).alias("c"), F.size(labels).alias("n"), F.array_join(labels, "; ").alias("text"), labels.alias("labels"))
        return F.when(F.size(f"_{i}") > 0, best)

    places = range(len(models))
    split = rows.select(*kept, *[mine(m).alias(f"_{i}") for i, m in enumerate(models)], F.array_sort(F.array_distinct(F.transform(votes, lambda v: v["label"]))).alias("_labels"))
    cells = split.select(*kept, F.transform("_labels", labelled).alias("_cells"), *[model_best(i).alias(f"_b{i}") for i in places])
    configs = F.array(*[F.struct(F.lit(c).alias("config"), *[F.lit(own.get(m)).cast("double").alias(f"w{i}") for i, m in enumerate(models)]) for c, own in grid.items()])
    met = F.filter(configs, lambda k: reduce(or_, [k[f"w{i}"].isNotNull() & F.col(f"_b{i}").isNotNull() for i in places]))
    each = cells.select("*", F.explode_outer(met).alias("_k")).where("_k IS NOT NULL")  # a condition on the votes would be worked out again below

    def weighed(x: Column) -> Column:
        """A label's weight, and its weighted confidence; a model that the configuration doesn't weigh has no vote."""
        parts = [(F.coalesce(F.col(f"_k.w{i}"), F.lit(0.0)), x[f"m{i}"]) for i in places]
        return F.struct(x["label"].alias("label"), reduce(add, [w * m["n"] for w, m in parts]).alias("w"), reduce(add, [w * m["c"] for w, m in parts]).alias("c"))

    won = F.filter(F.transform("_cells", weighed), lambda x: x["w"] >= least)
    best = [F.when(F.col(f"_k.w{i}").isNotNull(), F.col(f"_b{i}")) for i in places]
    best_of = F.greatest(*best) if len(best) > 1 else best[0]  # nulls are passed over
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v["c"] / v["w"]) / F.size(x)
    text = lambda x: F.transform(x, lambda v: v["label"])
    found = each.select(*kept, F.col("_k.config").alias("config"), won.alias("_won"), best_of.alias("_best"))
    any_ = F.size("_won") > 0
    return found.select(*kept, "config", F.when(any_, text("_won")).otherwise(F.col("_best.labels")).alias("chosen"), F.when(any_, mean("_won")).otherwise(F.col("_best.c")).alias("confidence"))


def weighted_labels(votes: DataFrame, weights: DataFrame, least: float = 2.0) -> DataFrame:
    """``config, row, labels, confidence``: labels whose weights reach ``least``, else those of the most confident model.

    ``votes(row, model, label, confidence)``, ``weights(config, model, weight)`` (few rows).  Confidence: the mean over the
    labels of their weighted mean confidence.  Ties between models go to more labels, then to the greater label text.
    A row's votes meet once, whatever the number of configurations.
    """
    rows = votes.groupBy("row").agg(F.collect_list(F.struct("model", "label", "confidence")).alias("votes"))
    return weighted_rows(rows, "votes", weights, least).select("config", "row", F.array_join("chosen", "; ").alias("labels"), "confidence")


def label_matrix(rows: DataFrame, key: list[str], truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """``(row, label, truth, predicted)`` 0/1 for each label, from two delimited cells."""
    t, p = split_cell(F.col(truth)), split_cell(F.col(predicted))
    each = F.array(*[F.struct(F.lit(x).alias("label"), F.array_contains(t, x).cast("int").alias("truth"), F.array_contains(p, x).cast("int").alias("predicted")) for x in labels])
    return rows.select(*key, F.explode(each).alias("m")).select(*key, "m.*")


def grid_metrics(joined: DataFrame, row: str, truth: str, models: list[str], weights: DataFrame, labels: list[str], least: float = 2.0) -> DataFrame:
    """The metrics of every weight configuration; ``joined`` has one row for each ``row``, and only counts are shuffled."""
    rows = joined.select(split_cell(F.col(truth)).alias("truth"), row_votes(models).alias("votes"))
    return cell_metrics(weighted_rows(rows, "votes", weights, least), "truth", "chosen", labels, ("config",))


def model_metrics(joined: DataFrame, row: str, truth: str, models: list[str], labels: list[str]) -> DataFrame:
    """The metrics of each model alone: ``model`` and the metric columns."""
    each = F.array(*[F.struct(F.lit(m).alias("model"), split_cell(F.col(f"{m}_prediction")).alias("labels")) for m in models])
    rows = joined.select(split_cell(F.col(truth)).alias("truth"), F.explode(each).alias("m")).select("truth", "m.*")
    return cell_metrics(rows, "truth", "labels", labels, ("model",))


def ranked(results: DataFrame, config: list[str]) -> DataFrame:
    """Tuning results with their place: compared metric by metric, then by configuration."""
    order = [F.asc(c) if up else F.desc(c) for c, up in TUNING_ORDER]
    return results.withColumn("rank", F.row_number().over(Window.orderBy(*order, *config)))  # one row a configuration


def fold_table(per_fold: DataFrame, config: list[str]) -> DataFrame:
    """Mean and deviation (of the population) of each metric over the folds, ranked."""
    aggs = []
    for c, _ in TUNING_ORDER:
        aggs += [F.avg(c).alias(c), F.stddev_pop(c).alias(f"std_{c}")]
    return ranked(per_fold.groupBy(*config).agg(*aggs, F.count("*").alias("folds")), config)


def stratified_split(df: DataFrame, stratum: str, key: str, share: float = 0.2, seed: int = 2026) -> DataFrame:
    """``part``: ``test`` for the nearest whole number to ``share`` of each stratum (at least one of two rows or more), else ``train``."""
    ranked = hash_ranks(df, stratum, F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"))), [key], "_rank", "_size")
    size = F.col("_size")
    wanted = F.when(size < 2, 0).otherwise(F.greatest(F.lit(1), F.floor(size * share + 0.5)))
    return ranked.withColumn("part", F.when(F.col("_rank") <= wanted, "test").otherwise("train")).drop("_rank", "_size")


def grid_search(df: DataFrame, settings: list[dict[str, float]], fit_predict: Callable[[DataFrame, DataFrame, dict[str, float]], DataFrame], k: int, measure: Callable[[DataFrame, tuple[str, ...]], DataFrame] = metrics) -> DataFrame:
    """The ranked table of all settings: ``fit_predict(train, test, setting)`` gives ``(row, label, truth, predicted)`` of a fold.

    ``df`` has ``fold`` from 0 to k - 1.  Every setting is measured on every fold, all by one aggregation: ``measure(predictions, by)``
    takes what ``fit_predict`` gives.  ``df`` is read for each of them, so it is best a written table.
    """
    parts: DataFrame | None = None
    for at, setting in enumerate(settings):
        for i in range(k):
            got = fit_predict(df.where(F.col("fold") != i), df.where(F.col("fold") == i), setting)
            one = got.withColumns({"config": F.lit(at), "fold": F.lit(i)})
            parts = one if parts is None else parts.unionByName(one)
    return fold_table(measure(parts, ("config", "fold")), ["config"])


def complete_table(observed: DataFrame, predictions: dict[str, DataFrame], key: str, label: str) -> DataFrame:
    """Every row's observed label, else each model's; ``label_observed`` tells which, ``<model>_label`` is complete for each model.

    ``predictions``: tables ``key, label`` of rows without an observed label.
    """
    out = observed.withColumn("label_observed", (~blank(F.col(label))).cast("int"))
    for model, table in predictions.items():
        own = table.select(key, F.col(label).alias(f"_{model}"))
        out = out.join(own, key, "left").withColumn(f"{model}_label", F.when(F.col("label_observed") == 1, F.col(label)).otherwise(F.coalesce(f"_{model}", F.lit("")))).drop(f"_{model}")
    return out


def label_text(labels: Column, scores: Column) -> Column:
    """Labels with their scores, the best first: ``A (0.900); B (0.500)``."""
    pairs = F.transform(F.arrays_zip(labels.alias("l"), scores.alias("s")), lambda x: F.struct((-x["s"]).alias("s"), x["l"].alias("l")))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: F.format_string("%s (%.3f)", x["l"], -x["s"])), "; ")
