"""Operators on heavy keys and large strata: the same rows as plain readings, without a task or a pair for each."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.operators import classify, consolidated, ensemble, linkage, ranking
from quillstone.plans import concentrating, facts
from quillstone.sources import sinks


def test_hash_ranks_are_those_of_one_window(spark):
    df = spark.createDataFrame([(i, [None, "a", "b"][min(2, i % 7)]) for i in range(2_000)] + [(5, "a")], "id int, s string")
    digest = F.md5(F.col("id").cast("string"))
    window = Window.partitionBy("s")
    want = df.select("id", "s", F.row_number().over(window.orderBy(digest, "id")).alias("r"), F.count("*").over(window).alias("n"))
    for cell_rows in (100_000, 300, 7):
        got = ranking.hash_ranks(df, "s", digest, ["id"], "r", "n", cell_rows)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert ranking.hash_ranks(df.limit(0), "s", digest, ["id"], "r").count() == 0


def test_folds_and_splits_are_dealt_by_cells(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 2).alias("s"))
    for out in (classify.folds(df, "s", "id", 5), ensemble.stratified_split(df, "s", "id")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert all("_cell" in x or "_of" in x or "_stratum" in x for x in plan.split("\n") if "Window [" in x)


def sides(spark, seed=1):
    r = random.Random(seed)
    row = lambda i: (i, r.choice(["", "", "k1", "k2", f"u{i}"]), r.choice(["", "x", "y"]), r.choice(["", "1", None]))
    ll, rr = [row(i) for i in range(150)], [row(1000 + i) for i in range(130)]
    kind = "doi string, last string, first string"
    return spark.createDataFrame(ll, f"a long, {kind}"), spark.createDataFrame(rr, f"b long, {kind}")


@pytest.mark.parametrize("part", [10_000, 3])
def test_classes_expand_to_the_pairs_of_the_outer_join(spark, part):
    left, right = sides(spark)
    keys = ["doi", "last", "first"], ["doi", "last"]
    want = linkage.two_pass_outer(left, right, ("a", "b"), *keys)
    classes = linkage.outer_classes(left, right, ("a", "b"), *keys)
    pairs = linkage.expand_classes(classes, ("a", "b"), part=part)
    assert sorted(map(tuple, pairs.collect())) == sorted(tuple(r) for r in want.where("a IS NOT NULL AND b IS NOT NULL").collect())
    only = {r["id"] for r in classes.where("strategy like '%only'").collect()}
    assert only == {r["a"] or r["b"] for r in want.where("strategy like '%only'").collect()}
    links = {r["strategy"]: r["links"] for r in linkage.class_links(classes).collect()}
    assert links == dict(Counter(r["strategy"] for r in pairs.collect()))
    few = linkage.expand_classes(classes, ("a", "b"), most=20)
    heavy = {r["strategy"]: 0 for r in classes.collect()}
    assert 0 < few.count() < pairs.count() and heavy


def test_blank_keys_stay_linear(spark):
    blanks = spark.range(3_000).select(F.col("id"), F.lit("").alias("k"))
    classes = linkage.outer_classes(blanks, blanks, ("id", "id"), ["k"], ["k"])
    assert classes.count() == 6_000
    assert linkage.class_links(classes).first()["links"] == 9_000_000


def test_unique_keys_are_counted_not_ranked(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, ""), (5, None), (6, " ")], "id int, k string")
    assert [tuple(r) for r in linkage.unique_keys(df, "k").collect()] == [(3, "b")]
    assert "Window" not in linkage.unique_keys(df, "k")._jdf.queryExecution().optimizedPlan().toString()


def test_counters_come_with_the_run(spark, tmp_path):
    df = spark.createDataFrame([(1, "", "x"), (2, "a", "y"), (3, None, " "), (4, " ", "z")], "id int, t string, src string")
    out, seen = consolidated.fill_in_run(df, {"t": "src"}, ("src", "absent"))
    assert out.columns == ["id", "t"]
    out.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"t_before": 1, "t_after": 3}
    assert {r["id"]: r["t"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "x", 2: "a", 3: None, 4: "z"}


def test_consolidated_names(spark):
    df = spark.createDataFrame([(1, " Ann ", "Anna", "ANN"), (2, None, "", " "), (3, "Bo", "Al", None)], "id int, a string, b string, c string")
    plan = {"first": ("first", ["a", "b"]), "longest": ("longest", ["a", "b", "c"]), "all": ("joined", ["a", "b", "c"])}
    got = {r["id"]: tuple(r)[1:] for r in consolidated.consolidated_names(df, plan, ["id", "first", "longest", "all"]).collect()}
    assert got == {1: ("Ann", "Anna", "Ann;Anna"), 2: ("", "", ""), 3: ("Bo", "Bo", "Bo;Al")}
    with pytest.raises(ValueError, match="nope"):
        consolidated.consolidated_names(df, {"x": ("first", ["nope"])}, ["id"])


def test_a_matrix_has_the_bytes_of_numpys_own(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, [r.random() for _ in range(3)]) for i in range(700)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, v array<double>").repartition(7)
    sinks.write_matrix(df, "k", "v", str(tmp_path / "a/m.npy"))
    np.save(tmp_path / "want.npy", np.array([v for _, v in sorted(rows)]))
    assert (tmp_path / "a/m.npy").read_bytes() == (tmp_path / "want.npy").read_bytes()
    keys = spark.read.parquet(str(tmp_path / "a/m.npy.keys")).orderBy("place").collect()
    assert [tuple(x) for x in keys] == [(i, i) for i in range(700)]
    with pytest.raises(ValueError, match="no matrix"):
        sinks.write_matrix(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "k int, v array<double>"), "k", "v", str(tmp_path / "bad.npy"))
    sinks.write_matrix(df.limit(0), "k", "v", str(tmp_path / "none.npy"))
    assert np.load(tmp_path / "none.npy").shape == (0,)


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x and "SinglePartition" not in x and "Broadcast" not in x]


def test_votes_and_metrics_of_all_configurations_stay_in_their_rows(spark):
    cells = ["A; B", "B", "C; A", "", "A"]
    rows = [(i, cells[i % 5], cells[i % 4], (i % 7) / 7, cells[i % 3], (i % 5) / 5) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, truth string, x_prediction string, x_confidence double, y_prediction string, y_confidence double")
    weights = ensemble.weight_grid(spark, {"x": [1.0, 2.0, 2.5], "y": [1.0, 2.0]})
    votes = df.select(F.col("id").alias("row"), ensemble.row_votes(["x", "y"]).alias("votes"))
    placed = ensemble.weighted_rows(votes, "votes", weights)
    assert not exchanges(placed)
    want = {(r["config"], r["row"]): (r["labels"], r["confidence"]) for r in ensemble.weighted_labels(ensemble.long_votes(df, "id", ["x", "y"]), weights).collect()}
    got = {(r["config"], r["row"]): ("; ".join(r["chosen"]), r["confidence"]) for r in placed.collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in got)
    grid = ensemble.grid_metrics(df, "id", "truth", ["x", "y"], weights, ["A", "B", "C"])
    assert len(exchanges(grid)) <= 2 and all("config" in x for x in exchanges(grid))  # counts of a configuration, no rows
    chosen = placed.withColumn("labels", F.array_join("chosen", "; ")).join(df.select(F.col("id").alias("row"), "truth"), "row")
    plain = classify.metrics(ensemble.label_matrix(chosen, ["config", "row"], "truth", "labels", ["A", "B", "C"]), ("config",))
    told = {r["config"]: r.asDict() for r in grid.collect()}
    assert told == {r["config"]: pytest.approx(r.asDict()) for r in plain.collect()}


def test_every_setting_is_measured_by_one_aggregation(spark):
    df = spark.range(80).select("id", (F.col("id") % 4).cast("int").alias("fold"), (F.col("id") % 3).alias("a"))
    seen = []

    def predictions(train, test, setting):
        return test.select(F.array(F.col("a").cast("string")).alias("t"), F.array(F.lit(setting["v"])).alias("p"))

    def measure(rows, by):
        seen.append(by)
        return classify.cell_metrics(rows, "t", "p", ["0", "1", "2"], by)

    got = ensemble.grid_search(df, [{"v": "0"}, {"v": "1"}], predictions, 4, measure)
    assert seen == [("config", "fold")] and [r["folds"] for r in got.collect()] == [4, 4]


def test_tasks_of_entry_types_hold_a_bounded_share_of_the_lines(spark, monkeypatch):
    sf_dir = "/root/testdata/sf0.001"
    lines = facts.table(spark, sf_dir, "lineitem").count()
    few = sorted(map(tuple, concentrating.field_entry_composition(spark, sf_dir).collect()))
    monkeypatch.setattr(facts, "TASK_LINES", 150)
    parts = -(-lines // 150)
    df = concentrating.field_entry_composition(spark, sf_dir)
    dealt = [x for x in exchanges(df) if f", {parts}), REPARTITION_BY_NUM" in x]
    assert len(dealt) == 5  # lines by author and by paper, authors by paper, fields by author and by paper
    assert sorted(map(tuple, df.collect())) == few
