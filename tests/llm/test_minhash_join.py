import random

import numpy as np
from pyspark.sql import functions as F

from quillstone.llm import minhash_join as M


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k": F.lit("x"), "node": F.lit(9), "component": F.lit(0), "bands": F.lit(-1), "set": F.lit("s"), "copy": F.lit(1)})


def brute(rows, t=0.8):
    sets = [set(M.shingles(x or "", 5).tolist()) for _, x in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted(((d, ids.get(find(i)) if sets[i] else d, links[i]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    rows = []
    for g in range(6):
        base = [word() for _ in range(120)]
        for c in range(12):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = word()
            rows.append((g * 100 + c, " ".join(t)))
    rows += [(700 + i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(30)]
    rows += [(800, ""), (801, None), (802, "!!! ..."), (803, "two words"), (804, "TWO words."), (805, " ".join(word() for _ in range(50_000))), (None, rows[0][1]), (None, "alone here"), rows[5], rows[5]]
    return rows


def test_links_and_classes_match_brute_force_in_small_blocks(spark):
    rows = corpus()
    got = M.similar(frame(spark, rows), M.JoinParams(block=4)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == brute(rows)


def test_blocks_of_different_sizes_give_equal_results(spark):
    rows = corpus(2)
    a, b = (sorted(map(str, M.similar(frame(spark, rows), M.JoinParams(block=n)).drop("class_key").collect())) for n in (3, 512))
    assert a == b


def test_one_of_each(spark):
    rows = corpus()
    df = frame(spark, rows)
    kept = M.one_of_each(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {c for _, c, _ in brute(rows) if c is not None}
    assert sorted(x for x in ids if x is not None) == sorted(want) and ids.count(None) == 1


def test_empty_table(spark):
    assert M.similar(frame(spark, [])).count() == 0 and M.one_of_each(frame(spark, [])).count() == 0


def test_banding_reaches_the_recall_and_verify_is_exact():
    bands, rows = M.banding(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, size=40)) for _ in range(30)]
    i, j = M.verify(sets, None, 0.4)
    want = {(a, b) for a in range(30) for b in range(a + 1, 30) if len(np.intersect1d(sets[a], sets[b])) >= 0.4 * len(np.union1d(sets[a], sets[b])) - 1e-9}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    i, j = M.verify(sets[:10], sets[10:], 0.4)
    assert {(a, b + 10) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == {(a, b) for a, b in want if a < 10 <= b}
