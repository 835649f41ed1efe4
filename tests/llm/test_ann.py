import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm.ann import AnnParams, fit_tree, nearest

P = AnnParams(leaf_rows=16, calibration_queries=64)


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({"key": F.lit("k"), "leaf": F.lit(1), "score": F.lit(2.0), "q": F.lit(True)}) if extra else df


def brute(rows, ids, k):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i in ids:
            scored = sorted((-float(v @ w), j) for j, w in good if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def test_recall_order_and_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # a hot vector
    rows += [(5000, None), (5020, [0.0] * 8), (5040, [float("nan")] * 8), (5060, [float("inf")] + [1.0] * 7), (5080, [None] + [1.0] * 7)]
    got = nearest(frame(spark, rows, True), F.col("vec_id") % 20 == 0, P).collect()
    want = brute(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(want)
    hits = 0
    for q, found in by.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, len(found) + 1))
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hits += len({v for _, v, _ in found} & {v for v, _ in want[q]})
    assert hits / sum(len(v) for v in want.values()) >= 0.9
    hot = next(q for q in by if q >= 1000)
    assert [v for _, v, _ in by[hot]] == [v for v, _ in want[hot]]


def test_ties_between_distinct_vectors_go_to_smaller_ids(spark):
    rng = np.random.default_rng(5)
    ids = rng.permutation(300) + 1
    rows = [(0, [1.0] + [0.0] * 7)] + [(int(i), [1.0, *rng.normal(size=7).astype(np.float32).tolist()]) for i in ids]
    got = nearest(frame(spark, rows), F.col("vec_id") == 0, AnnParams(leaf_rows=400)).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, 1.0) for i in range(1, 21)]


def test_groups_and_parts_give_the_same_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(800)]
    tiny = AnnParams(leaf_rows=200, calibration_queries=64, group_bytes=8_000, hot_rows=2)
    rows += [(2000 + i, rows[20][1]) for i in range(9)]
    whole = AnnParams(leaf_rows=200, calibration_queries=64)
    every = [sorted(map(tuple, nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, p).collect())) for p in (tiny, whole)]
    assert every[0] == every[1]


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]
    got = nearest(frame(spark, rows), F.col("vec_id") == 0, P).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 0.5), (2, 0.5)]
    assert nearest(frame(spark, []), F.col("vec_id") == 0, P).count() == 0
    assert nearest(frame(spark, [(0, [1.0])]), F.col("vec_id") == 0, P).count() == 0


def test_tree_reaches_every_leaf_best_first():
    x = np.random.default_rng(2).normal(size=(500, 4))
    tree = fit_tree(x, 20, AnnParams(branching=4))
    assert tree.leaves >= 15
    assert sorted(tree.best_first(x[0], 10**6)) == list(range(tree.leaves))
    assert set(tree.assign(x)) <= set(range(tree.leaves))
    assert pytest.approx(fit_tree(np.ones((10, 3)), 5, AnnParams()).leaves) == 1


def wide(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_products_that_overflow_are_ties(spark):
    rows = [(i, [1e200 * (i + 1), 1.0]) for i in range(60)]
    got = nearest(wide(spark, rows), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert len(got) == 60 and all(r["score"] == float("inf") for r in got)
    assert [r["vec_id"] for r in got if r["query_id"] == 20] == list(range(20))
    mixed = [(0, [1e200, 1.0]), (1, [-1e200, 3.0]), (2, [1e-5, 2.0]), (3, [0.0, 5.0]), (4, [1e200, 1.0]), (5, [-1e300, 1.0])]
    got = nearest(wide(spark, mixed), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [4, 2, 3, 1, 5] and got[-1]["score"] == float("-inf")
    both = [(0, [1e200, 1e200]), (1, [1e200, -1e200]), (2, [1.0, 1.0])]
    got = nearest(wide(spark, both), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 2e200), (1, float("-inf"))]
