"""Links of names in blocks of any size, and numbers of keys, against plain readings of their definitions."""

import random
from difflib import SequenceMatcher

import pytest

from quillstone.operators import names

ROW = "key string, first string, last string"


def brute_similar(rows, least, letters):
    out = {}
    for ka, fa, la in rows:
        for kb, fb, lb in rows:
            if ka < kb and la == lb and fa != fb and fa[0] == fb[0] and min(len(fa), len(fb)) >= letters:
                ratio = SequenceMatcher(None, fa, fb).ratio()
                if ratio >= least:
                    out[ka, kb] = ratio
    return out


def made_up(seed, n, longest):
    """Names and variants of them with letters left out, put in, doubled and changed."""
    r, found = random.Random(seed), set()
    while len(found) < n:
        word = [r.choice("abcé") if r.random() < 0.5 else r.choice("aklm") for _ in range(r.randint(1, longest))]
        found.add("".join(word))
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(word))
            word[at : at + r.randint(0, 2)] = [r.choice("abkx") for _ in range(r.randint(0, 2))]
            if not word:
                break
            found.add("".join(word))
    return [(f"{last}_{first}", first, last) for last in ("li", "wang") for first in sorted(found)]


@pytest.mark.parametrize(("least", "letters", "longest"), [(0.92, 4, 30), (0.8, 4, 14), (0.7, 1, 9), (1.0, 2, 8)])
def test_similar_pairs_are_those_of_all_pairs(spark, least, letters, longest):
    rows = made_up(int(least * 100), 250, longest)
    got = {(r["key_a"], r["key_b"]): r["ratio"] for r in names.similar_pairs(spark.createDataFrame(rows, ROW), least, letters).collect()}
    want = brute_similar(rows, least, letters)
    assert got == want
    assert bool(want) == (least < 1)


def test_similar_pairs_join_on_more_than_the_last_name(spark):
    plan = names.similar_pairs(spark.createDataFrame([("a_b", "b", "a")], ROW))._jdf.queryExecution().optimizedPlan().toString()
    (join,) = [x for x in plan.split("\n") if "Join Inner" in x]
    assert join.count(" = ") >= 6
    with pytest.raises(ValueError, match="2/3"):
        names.similar_pairs(spark.createDataFrame([("a_b", "b", "a")], ROW), 0.6)


def test_prefix_pairs_are_those_of_all_pairs(spark):
    rows = made_up(1, 200, 8)
    got = sorted((r["key_a"], r["key_b"]) for r in names.prefix_pairs(spark.createDataFrame(rows, ROW)).collect())
    want = sorted((min(a[0], b[0]), max(a[0], b[0])) for a in rows for b in rows if a[2] == b[2] and a[1] != b[1] and len(a[1]) >= 3 and b[1].startswith(a[1]))
    assert got == want and want


def test_null_and_blank_names_meet_nothing(spark):
    rows = [("x", None, "a"), ("y", "", "a"), ("z", "johnathan", None), ("u", "johnathon", None), ("v", "johnathan", "a"), (None, "johnathans", "a")]
    frame = spark.createDataFrame(rows, ROW)
    assert [r["key_a"] for r in names.similar_pairs(frame, 0.9).collect()] == [] and names.prefix_pairs(frame).count() <= 1
    assert names.similar_pairs(frame.limit(0)).count() == 0


def test_numbers_follow_the_order_of_keys_of_one_beginning(spark):
    keys = [f"smith_{i:05d}" for i in range(3_000)] + ["", None, "smith", "smith_00001"]
    random.Random(4).shuffle(keys)
    frame = spark.createDataFrame([(k,) for k in keys], "key string").repartition(5)
    got = {r["key"]: r["id"] for r in names.numbered(frame, "key", "id", "AEX%06d").collect()}
    assert got == {k: f"AEX{i:06d}" for i, k in enumerate(sorted({k for k in keys if k}), 1)}
    plan = names.numbered(frame, "key", "id", "AEX%06d")._jdf.queryExecution().optimizedPlan().toString()
    assert all("_range" in x and "key" not in x for x in plan.split("\n") if "Window [" in x)
    assert names.numbered(frame.limit(0), "key", "id", "A%d").count() == 0
