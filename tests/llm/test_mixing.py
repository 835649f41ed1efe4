import heapq
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import mixing as X

P = X.MixParams(block=16, shard=500)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit(9), "sid": F.lit(1), "shard": F.lit("x"), "n_chars": F.lit(5).cast("long"), "start": F.lit(0), "full": F.lit(7)})


def brute_targets(sizes, weights, most):
    t, capped, left = [0.0] * len(sizes), set(), float(sum(sizes))
    while True:
        open_ = [i for i in range(len(sizes)) if i not in capped]
        if not open_:
            return t
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in open_:
                t[i] = left * weights[i] / w
            return t
        for i in over:
            t[i] = most * sizes[i]
            capped.add(i)
            left -= t[i]


def test_targets_match_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = rng.integers(1, 30)
        sizes, weights = rng.integers(0, 1000, size=n), np.array([(5, 2, 1)[i % 3] for i in range(n)])
        assert X.targets(sizes, weights, 3).tolist() == pytest.approx(brute_targets(sizes.tolist(), weights.tolist(), 3), rel=1e-9)


def test_seats_are_the_highest_quotients():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 12))
        votes, most, seats = rng.integers(0, 500, size=n).astype(float), rng.integers(0, 40, size=n), int(rng.integers(0, 150))
        heap, want = [(-v, i, 0) for i, v in enumerate(votes) if v > 0 and most[i] > 0], [0] * n
        heapq.heapify(heap)
        for _ in range(seats):
            if not heap:
                break
            _, i, k = heapq.heappop(heap)
            want[i] += 1
            if k + 1 < most[i]:
                heapq.heappush(heap, (-votes[i] / (2 * k + 3), i, k + 1))
        got = X.sainte_lague(votes, seats, most)
        assert got.sum() == sum(want)
        assert np.abs(got - np.array(want)).max() <= 1
        if len(set(votes.tolist())) == n:
            q = [votes[i] / (2 * w - 1) for i, w in enumerate(want) if w]
            r = [votes[i] / (2 * w - 1) for i, w in enumerate(got.tolist()) if w]
            assert sorted(q) == pytest.approx(sorted(r))


def corpus():
    rows = [(i, f"w{i} x\u00a0y\t\n" * (i % 40 + 1), ["big", "mid", "tiny", "Big"][0 if i % 3 else i % 4]) for i in range(400)]
    return rows + [(900, None, "mid"), (901, " ", None), (902, "some words of no source", None), (None, "no id here", "mid"), rows[0], rows[0], (903, "long " * 30_000, "big")]


def test_sizes_targets_and_taken_words(spark):
    rows = corpus()
    got = X.mix(frame(spark, rows), P).collect()
    assert len(got) == len(rows)
    assert sorted(r["size"] for r in got) == sorted(len(WORD.findall(t or "")) for _, t, _ in rows)
    sources = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = [sum(len(WORD.findall(t or "")) for _, t, s in rows if s == x) for x in sources]
    want = dict(zip(sources, brute_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))], 3), strict=True))
    for x, size in zip(sources, sizes, strict=True):
        own = [r for r in got if r["source"] == x]
        assert {r["source_size"] for r in own} == {size} and own[0]["target"] == pytest.approx(want[x])
        assert abs(sum(r["taken"] for r in own) - want[x]) <= 1
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    again = X.mix(frame(spark, rows).repartition(7), P).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_documents_hold_the_taken_words(spark):
    rows = corpus()
    df = frame(spark, rows)
    taken = sum(r["taken"] for r in X.mix(df, P).collect())
    mixed = X.mixed_documents(df, P)
    assert mixed.columns == df.columns
    got = mixed.collect()
    assert sum(len(WORD.findall(r["text"])) for r in got) == taken
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    whole = {(d, t or "") for d, t, _ in rows}
    assert all((r["doc_id"], r["text"]) in whole or len(r["text"]) for r in got)


def test_one_text_in_several_sources_keeps_its_words(spark):
    shared = [(7, "same words in two sources " * 40, s) for s in ("a", "b", None)]
    rows = [(i, f"word{i} " * 50, "a") for i in range(60)] + [(100 + i, f"other{i} " * 50, "b") for i in range(7)] + shared * 2 + [(7, shared[0][1], "a")]
    df = frame(spark, rows)
    want, got = {}, {}
    for r in X.mix(df, P).collect():
        want[r["source"]] = want.get(r["source"], 0) + r["taken"]
    for r in X.mixed_documents(df, P).collect():
        got[r["source"]] = got.get(r["source"], 0) + len(WORD.findall(r["text"]))
    assert {k: v for k, v in want.items() if v} == got


def test_empty_and_wordless(spark):
    assert X.mix(frame(spark, []), P).count() == 0 and X.mixed_documents(frame(spark, []), P).count() == 0
    got = X.mix(frame(spark, [(1, None, "a"), (2, " ", "b")]), P).collect()
    assert {(r["size"], r["target"], r["taken"]) for r in got} == {(0, 0.0, 0)}


def test_quotas_are_met_to_the_word():
    for block in (1, 3, 16):
        for size in (1, 2, 5, 16, 33, 47):
            n = -(-size // block)
            for stride in [k for k in range(1, n + 1) if np.gcd(k, n) == 1]:
                for first in range(n):
                    for words in range(size + 1):
                        quota, extra = X._whole(words, size, n, stride, first, block)
                        text = " ".join(f"w{i}" for i in range(size))
                        assert len(X.runs(text, 0, quota, n, stride, first, extra, block).split()) == words


def test_small_sources_meet_their_targets(spark):
    rows = [(i, f"w{i} " * (i % 7 + 1), f"s{i % 50}") for i in range(600)]
    own = {}
    for r in X.mix(frame(spark, rows)).collect():
        taken, _ = own.get(r["source"], (0, 0))
        own[r["source"]] = taken + r["taken"], r["target"]
    assert len(own) == 50 and all(abs(taken - target) <= 1 for taken, target in own.values())
