import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import kneser_ney as K
from quillstone.llm.common import bucketed, shared_dir

P = K.QualityParams(chunk_tokens=200, shard_pairs=50, least_trusted=2)


def brute_perplexities(docs, trusted, p):
    """``{id: (raw, fitted, judged)}``: interpolated modified Kneser-Ney over pairs of symbols, by the definition."""
    text = {i: t or "" for i, t, _ in docs}
    lang = {i: g or "\x00" for i, _, g in docs}
    words = Counter((lang[i], w) for i in trusted for w in K._TOKEN.findall(text[i]))
    known = {k for k, n in words.items() if n >= p.least_count}
    owns = {g for g, _ in known}

    def symbol(g, w):
        return ("w", g, w) if (g, w) in known else ("c", g if g in owns else "", K.shape(w))

    ids = {i: [("c", lang[i] if lang[i] in owns else "", -1), *(symbol(lang[i], w) for w in K._TOKEN.findall(text[i]))] for i in text}
    bi = Counter()
    for i in trusted:
        bi.update(zip(ids[i], ids[i][1:], strict=False))
    uni = Counter(c for _, c in bi)

    def discounts(counts):
        return K._discounts(*[sum(1 for v in counts.values() if v == k) for k in (1, 2, 3, 4)])

    d2, d1 = discounts(bi), discounts(uni)
    ctx = defaultdict(list)
    for (b, _), n in bi.items():
        ctx[b].append(n)

    def back(counts, d):
        return sum(d[min(n, 3) - 1] for n in counts) / sum(counts)

    def p1(w, less=0):
        same = [n for v, n in uni.items() if v[1] == w[1]]
        kinds = sum(1 for g, _ in known if g == w[1]) + 7
        n = uni[w] - less
        return (max(n - d1[min(n, 3) - 1], 0) / sum(same) if n > 0 else 0) + (back(same, d1) if same else 1.0) / kinds

    def p2(b, c, own=None):
        """``own``: the document's pairs, which are taken off."""
        own = own or Counter()
        n, s = bi[b, c] - own[b, c], sum(ctx.get(b, [])) - sum(k for (x, _), k in own.items() if x == b)
        low = p1(c, sum(1 for x in own if x[1] == c and bi[x] == own[x]))
        return (max(n - d2[min(n, 3) - 1], 0) / s if n > 0 else 0) + back(ctx[b], d2) * low if s > 0 else low

    def total(i, own=None):
        return -sum(math.log(p2(*g, own)) for g in zip(ids[i], ids[i][1:], strict=False))

    nats = {i: total(i) for i in ids}
    new = {i: total(i, Counter(zip(ids[i], ids[i][1:], strict=False))) if i in set(trusted) else nats[i] for i in ids}
    n = {i: len(x) - 1 for i, x in ids.items()}
    mean_all = sum(new[i] for i in trusted) / sum(n[i] for i in trusted)
    means = {}
    for g in set(lang.values()):
        own = [i for i in trusted if lang[i] == g and n[i]]
        means[g] = sum(new[i] for i in own) / sum(n[i] for i in own) if own else mean_all
    return {i: (math.exp(nats[i] / n[i]), *(math.exp((x[i] + p.prior_tokens * means[lang[i]]) / (n[i] + p.prior_tokens)) for x in (nats, new))) for i in text if n[i]}


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({"trusted": F.lit("x"), "h": F.lit(1), "chunk": F.lit(2), "mean": F.lit(3), "keep": F.lit(False)})


def corpus():
    good = [(i, f"The cat number {i} sat on the mat, and the dog saw it. The {['red', 'blue', 'old'][i % 3]} cat ran home.", "en") for i in range(30)]
    good += [(100 + i, f"Der Hund lief nach Haus {i} und die Katze sah ihn. Der alte Hund.", "de") for i in range(12)]
    bad = [(200, "CAT!! *** ||| %%% CAT!! *** ||| %%% CAT!! *** ||| %%% " * 5, "en"), (201, "x " * 300, "en"), (202, "", "en"), (203, None, None), (204, "the cat", None), (205, "word", "fr")]
    return good + bad, [i for i, _, _ in good if i % 2 == 0]


def test_perplexity_is_the_models_definition(spark):
    docs, trusted = corpus()
    ids = spark.createDataFrame([(i,) for i in trusted] + [(None,), (trusted[0],)], "doc_id long")
    got = {r["doc_id"]: r for r in K.judge(frame(spark, docs).repartition(3), ids, P).collect()}
    want = brute_perplexities(docs, trusted, P)
    assert len(got) == len(docs)
    for i, p in want.items():
        assert (got[i]["perplexity"], got[i]["fitted"], got[i]["judged"]) == pytest.approx(p, rel=1e-9), i
    assert got[202]["perplexity"] is None and not got[202]["keep"] and not got[203]["keep"]
    assert not got[200]["keep"]
    assert all(got[i]["keep"] for i, _, _ in docs[:42])


def test_accepted_keeps_rows_and_columns(spark):
    docs, trusted = corpus()
    df = frame(spark, docs + [docs[0], (None, docs[1][1], "en")])
    kept = K.accepted(df, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), P)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(0) == 2 and None in ids and 200 not in ids and 202 not in ids


def test_nothing_trusted_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long")
    got = {r["doc_id"]: r["keep"] for r in K.judge(frame(spark, [(1, "a b", "en"), (2, " ", "en"), (3, None, None)]), none, P).collect()}
    assert got == {1: True, 2: False, 3: False}
    assert K.judge(frame(spark, []), none, P).count() == 0


def test_every_word_seen_twice_is_a_symbol(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    docs = [(i, " ".join(words[(7 * i + 3 * j) % 300] for j in range(40)), "en") for i in range(60)]
    docs += [(100, " ".join(words[(21 + 3 * j) % 300] for j in range(40)), "en"), (101, " ".join(f"x{w}" for w in docs[3][1].split()), "en")]
    p = K.QualityParams(chunk_tokens=200)
    trusted = [i for i in range(60)]
    got = {r["doc_id"]: r["perplexity"] for r in K.judge(frame(spark, docs).repartition(3), spark.createDataFrame([(i,) for i in trusted], "doc_id long"), p).collect()}
    for i, (x, *_) in brute_perplexities(docs, trusted, p).items():
        assert got[i] == pytest.approx(x, rel=1e-9), i
    # unknown words of the same shape are not like the known ones
    assert got[101] > 2 * got[100]


def test_chunks_stay_in_their_buckets(spark):
    docs, trusted = corpus()
    enc = bucketed(spark.range(10).withColumnRenamed("id", "chunk"), "chunk", "test-chunks")
    other = spark.range(10).withColumnRenamed("id", "part")
    joined = enc.groupBy("chunk").cogroup(other.groupBy("part")).applyInPandas(lambda a, b: a, "chunk long")
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(part") == 1
    assert "Exchange hashpartitioning(chunk" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 10


def test_packing_round_trip():
    for x in ([], [0], [1, 2, 2**62, -5], list(range(1000))):
        assert K._unpack(K._pack(np.array(x, dtype=np.int64))).tolist() == x


def test_very_long_text_and_repeated_rows(spark):
    docs, trusted = corpus()
    long = ("the cat sat on the mat , and " * 30_000, "en")
    rows = [*docs, (300, *long), (300, *long), docs[3]]
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    got = [(r["doc_id"], r["n_tokens"], r["perplexity"]) for r in K.judge(frame(spark, rows), ids, P).collect()]
    assert len(got) == len(rows)
    assert sorted(n for i, n, _ in got if i == 300) == [240_000, 240_000]
    assert len({round(x, 9) for i, _, x in got if i in (300,)}) == 1


def test_new_clean_documents_are_kept_like_trusted_ones(spark):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "bdfglmnprst" for b in ("an", "el", "ir", "om", "us")]
    share = 1 / np.arange(1, len(words) + 1)

    def prose(n):
        return " ".join(rng.choice(words, size=n, p=share / share.sum()))

    docs = [(i, prose(120), "en") for i in range(300)] + [(1000 + i, " ".join(rng.permutation([w[::-1] + "q" for w in words])), "en") for i in range(20)]
    trusted = spark.createDataFrame([(i,) for i in range(150)], "doc_id long")
    kept = {r["doc_id"] for r in K.judge(frame(spark, docs + [(500 + i, docs[i][1], "en") for i in range(20)]), trusted, K.QualityParams()).where("keep").collect()}
    assert len(kept & set(range(150))) >= 146 and len(kept & set(range(150, 300))) >= 144
    assert len(kept & set(range(500, 520))) >= 19  # untrusted copies of trusted text
    assert not kept & set(range(1000, 1020))


def test_only_the_scores_stay_on_disk(spark):
    docs, trusted = corpus()
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    where = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(where))
    tables, key = spark.catalog.listTables(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    cleanup = spark.conf.get(key)
    got = K.judge(frame(spark, docs).repartition(3), ids, P)
    left = set(os.listdir(where)) - before
    assert len(left) == 1 and "kn-scored" in left.pop()
    assert spark.catalog.listTables() == tables and spark.conf.get(key) == cleanup
    assert got.count() == len(docs)


def test_passes_over_the_pairs_do_not_change_the_model(spark):
    docs, trusted = corpus()
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    one, three = ({r["doc_id"]: tuple(r) for r in K.judge(frame(spark, docs), ids, K.QualityParams(chunk_tokens=200, shard_pairs=50, pair_passes=n)).collect()} for n in (1, 3))
    assert one == three


def test_scores_are_the_same_in_blocks_of_any_size(spark):
    docs = [(i, " ".join(f"w{(i * k) % 7}" for k in range(i % 9)), "en") for i in range(60)]
    df, trusted = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long")
    found = []
    for tokens in (1, 50, 10_000):
        rows = K.judge(df, trusted, K.QualityParams(block_tokens=tokens, least_trusted=2)).orderBy("doc_id").collect()
        found.append(([(r["doc_id"], r["n_tokens"], r["keep"]) for r in rows], np.array([[r[c] for c in ("perplexity", "fitted", "judged")] for r in rows], dtype=float)))
    assert len(found[0][0]) == 60 and all(x[0] == found[0][0] for x in found)
    for _, values in found[1:]:
        np.testing.assert_allclose(values, found[0][1], rtol=1e-12)


def test_blocks_are_all_documents():
    sizes = np.array([0, 3, 500, 0, 0, 99, 1, 100, 0])
    at = K._blocks(sizes, 100)
    assert [i for x in at for i in range(x.start, x.stop)] == list(range(len(sizes)))
    assert all(sizes[x][:-1].sum() <= 100 for x in at) and len(at) > 3


@pytest.mark.parametrize("text", ["", " \t\n", "a\x1cb\x1d\x1e\x1fc\x85d\xa0e f g​h　i﻿j᠎k", "don't--stop. É \ud800x _a_b漢字。ab1²½ \\g<0> \\1", "\x00a\x0bb\x0c.\r!\x7f ? "])
def test_tokens_are_those_of_the_pattern(text):
    assert K._tokens(text) == K._TOKEN.findall(text)


def test_places_of_pairs_are_sorted_for_not_searched_for(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = np.array([0, 700, 1, 299])
    tokens, starts = rng.integers(3, 40, size=1000).astype(np.int32), np.array([0, 1, 2, 0], dtype=np.int32)
    ids = rng.permutation(1 << 20)[:40] * 2
    before = K._before(tokens, starts, sizes)
    monkeypatch.setattr(K.np, "searchsorted", None)  # before, each token's pair was searched for
    got = K._Pairs.of(ids, tokens, starts, sizes)
    want = sorted({*zip(ids[before].tolist(), ids[tokens].tolist(), strict=True)})
    assert list(zip(got.b.tolist(), got.c.tolist(), strict=True)) == want
    assert (got.b[got.at] == ids[before]).all() and (got.c[got.at] == ids[tokens]).all()


def test_places_of_numbers_too_large_to_hold_positions():
    x = np.array([1 << 61, 5, 0, 5, (1 << 61) + 1, 0], dtype=np.int64)
    for below in (6, 1 << 62):
        own = x if below > 6 else x % 6
        once, at = K._places(own, below)
        assert once.tolist() == sorted({*own.tolist()}) and (once[at] == own).all() and at.dtype == np.int32
    once, at = K._places(np.empty(0, dtype=np.int64), 0)
    assert len(once) == len(at) == 0
