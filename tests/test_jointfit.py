"""Terms in SQL and models fitted together, against separate ones."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from quillstone.operators import classify, jointfit, terms

TEXTS = ["The model of trade and growth", "Growth, growth and TRADE models!", "Taxes in a model of growth", "", None, "Été à la plage: growth", "taxes taxes trade x1 x1", "the of and", "trade growth trade growth"]


def test_terms_have_the_weights_of_the_pipeline(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got, known = terms.tfidf_arrays(df, "id", "text", n=2, min_df=2, max_df=0.9)
    names = {r["index"]: r["term"] for r in known.collect()}
    assert sorted(names) == list(range(len(names)))
    features, model = classify.tfidf(df.na.fill(""), "text", n=2, min_df=2, max_df=0.9)
    words = model.stages[0].vocabulary
    assert set(words) == set(names.values()) and any(" " in w for w in words)
    want = {r["id"]: {words[i]: v for i, v in enumerate(r["v"]) if v} for r in features.select("id", vector_to_array("features").alias("v")).collect()}
    for r in got.collect():
        own = {names[i]: v for i, v in zip(r["indices"], r["values"], strict=True)}
        assert own == pytest.approx(want[r["row"]]) and r["indices"] == sorted(r["indices"])
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "UDF" not in plan


def test_three_grams_and_the_size_of_the_vocabulary(spark):
    df = spark.createDataFrame([(1, "b c d e"), (2, "b c d"), (3, "b")], "id int, text string")
    got = [r["g"] for r in df.orderBy("id").select(terms.grams(F.col("text"), 3, []).alias("g")).collect()]
    assert got == [["b", "c", "d", "e", "b c", "c d", "d e", "b c d", "c d e"], ["b", "c", "d", "b c", "c d", "b c d"], ["b"]]
    _, known = terms.tfidf_arrays(df, "id", "text", n=3, min_df=2, max_df=1.0, vocabulary=3)
    assert [r["term"] for r in known.orderBy("index").collect()] == ["b", "b c", "b c d"]
    vectors, known = terms.tfidf_arrays(df.limit(0), "id", "text")
    assert vectors.count() == known.count() == 0


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(240, 5)) * [1, 2, 0.5, 1, 3]
    a, b = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=240) > 0.8).astype(int), (x[:, 2] - x[:, 4] + 2 * rng.normal(size=240) > -1).astype(int)
    rows = [(i, v.tolist(), int(p), int(q), i % 3) for i, (v, p, q) in enumerate(zip(x, a, b, strict=True))]
    return jointfit.dense(spark.createDataFrame(rows, "row long, v array<double>, a int, b int, fold int").repartition(3), "v")


def test_models_fitted_together_are_those_fitted_alone(data):
    every = jointfit.fit_all(data, 5, ["a", "b"], [0, 1, 2, None], [0.01, 1.0])
    assert len(every.models) == 16 and every.passes < 60
    alone = 0
    for j in (0, 5, 11, 14):
        m = every.models[j]
        one = jointfit.fit_all(data, 5, [m.label], [m.fold], [m.strength])
        alone += one.passes
        assert np.abs(one.weights[:, 0] - every.weights[:, j]).max() < 1e-6
    assert every.passes < alone  # four of sixteen cost more passes than all together


def test_models_are_those_of_the_library(data):
    fitted = jointfit.fit_all(data, 5, ["a"], [None, 1], [0.05])
    for j, train in enumerate((data, data.where("fold <> 1"))):
        weighted = classify.balanced_weights(train, "a").withColumn("features", array_to_vector("v"))
        want = LogisticRegression(labelCol="a", weightCol="weight", regParam=0.05, standardization=False, tol=1e-10, maxIter=200).fit(weighted)
        assert np.abs(fitted.weights[:-1, j] - want.coefficients.toArray()).max() < 1e-4 and abs(fitted.weights[-1, j] - want.intercept) < 1e-4


def test_scores_are_out_of_fold(data):
    labels = ["a", "b"]
    fitted = jointfit.fit_all(data, 5, labels, [0, 1, 2], [0.1])
    rows = jointfit.predict_all(data, fitted, labels).collect()
    assert len(rows) == 480 and all(r["fold"] == r["row"] % 3 for r in rows)
    own = {r["row"]: r for r in rows if r["label"] == "a"}
    x = {r["row"]: r["v"] for r in data.select("row", "v").collect()}
    w = fitted.weights[:, [m.label == "a" and m.fold == 1 for m in fitted.models]][:, 0]
    assert own[4]["score"] == pytest.approx(1 / (1 + np.exp(-(np.array(x[4]) @ w[:-1] + w[-1]))))
    right = sum((r["score"] > 0.5) == r["truth"] for r in rows) / len(rows)
    assert right > 0.7


def test_one_class_and_no_rows(spark, data):
    fitted = jointfit.fit_all(data.withColumn("a", F.lit(1)), 5, ["a"], [None], [0.1])
    assert np.isfinite(fitted.weights).all() and fitted.weights[-1, 0] > 3
    none = jointfit.fit_all(data.limit(0), 5, ["a"], [None], [0.1])
    assert not none.weights.any() and jointfit.predict_all(data.limit(0), none, ["a"]).count() == 0


def test_scaled_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "row int, v array<float>")
    got, n = jointfit.scaled(df, "v")
    assert n == 2 and sorted(r["values"] for r in got.collect()) == [[pytest.approx(-(0.5**0.5)), 0.0], [pytest.approx(0.5**0.5), 0.0]]


def test_blocks_keep_every_number_and_sum_without_sorting(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jointfit, "BLOCK", 5)
    monkeypatch.setattr(jointfit, "PER_FEATURE", 1)
    rows = [([0, 2], [1.0, 2.0]), ([], []), ([1, 2, 3], [3.0, 4.0, 5.0]), ([], []), ([0, 1, 2, 3], [1.0, 1.0, 1.0, 1.0]), ([3], [7.0])]
    b = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64())), pa.array(range(6), pa.int32()), pa.array([[1.0]] * 6)], names=["indices", "values", "fold", "y"])
    w = np.arange(10.0).reshape(5, 2)
    dense = np.zeros((6, 4))
    for i, (at, v) in enumerate(rows):
        dense[i, at] = v
    packed = [r for x in jointfit._blocks(4)(iter([b.slice(0, 6)])) for r in x.to_pylist()]
    assert len(packed) == 2
    got = [jointfit._scores(np.frombuffer(r["sizes"], np.int32), np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"]), w) for r in packed]
    assert np.allclose(np.concatenate(got), dense @ w[:-1] + w[-1])
    assert np.concatenate([np.frombuffer(r["fold"], np.int32) for r in packed]).tolist() == list(range(6))


def test_every_model_takes_its_next_step_in_each_pass(data):
    every = jointfit.fit_all(data, 5, ["a", "b"], [0, 1, None], [1e-4, 1.0])
    alone = [jointfit.fit_all(data, 5, [m.label], [m.fold], [m.strength]).passes for m in every.models[::2]]  # the small strength, which takes longest
    assert every.passes <= max(alone) + 2  # sums come in another order, so a model may need a step more


def test_the_diagonal_at_the_start_saves_passes():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 40)) * np.geomspace(0.01, 1, 40)
    y, total = (x @ rng.normal(size=40) > 0).astype(float), []

    def evaluate(w, cols, curved, known=True):
        p = 1 / (1 + np.exp(-(x @ w[:, :-1].T + w[:, -1])))
        loss = -(np.log(np.where(y[:, None] > 0, p, 1 - p))).mean(0) + 1e-3 / 2 * (w[:, :-1] ** 2).sum(1)
        bend = np.column_stack([(p * (1 - p)).T @ x**2 / 300 + 1e-3, (p * (1 - p)).mean(0)]) if known else np.ones(w.shape)
        return loss, np.column_stack([(p - y[:, None]).T @ x / 300 + 1e-3 * w[:, :-1], (p - y[:, None]).mean(0)]), bend if curved else None

    for known in (True, False):
        w, passes = jointfit.minimise(lambda *a, k=known: evaluate(*a, known=k), np.zeros((2, 41)), 200, 1e-9)
        assert np.abs(evaluate(w, np.arange(2), False)[1]).max() <= 1e-9 and np.allclose(w[0], w[1])
        total.append(passes)
    assert total[0] < total[1]


def test_a_long_text_is_weighted_once_for_each_term(spark):
    import time

    text = " ".join(f"w{i}" for i in range(20_000))
    df = spark.createDataFrame([(1, text), (2, text), (3, "other")], "id int, text string")
    start = time.monotonic()
    got = {r["row"]: r["values"] for r in terms.tfidf_arrays(df, "id", "text", vocabulary=50_000)[0].collect()}
    assert time.monotonic() - start < 30  # a norm for each term would be 1.6e9 steps a row
    assert len(got[1]) == 39_999 and got[1] == pytest.approx([39_999**-0.5] * 39_999) and got[3] == []


def test_a_pass_reads_equal_files_in_whole_rounds(spark, data, monkeypatch):
    monkeypatch.setattr(jointfit, "BLOCK", 60)
    seen, by_file = [], jointfit._by_file
    monkeypatch.setattr(jointfit, "_by_file", lambda s: seen.append(by_file(s)) or seen[-1])
    monkeypatch.setattr(jointfit.Scratch, "drop", lambda self, keep=0: seen.append(self.paths[-1]))
    want = jointfit.fit_all(data, 5, ["a"], [None], [0.1])
    assert seen[0].read.parquet(seen[1]).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.files.openCostInBytes") != seen[0].conf.get("spark.sql.files.openCostInBytes")
    monkeypatch.undo()
    assert np.allclose(want.weights, jointfit.fit_all(data, 5, ["a"], [None], [0.1]).weights, atol=1e-5)
