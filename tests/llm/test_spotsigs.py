import hashlib

from pyspark.sql import functions as F

from quillstone.llm import spotsigs as S


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"b": F.lit("x"), "extra": F.lit(9), "head": F.lit(0), "n_chars": F.lit(-1)})


def brute(spark, rows):
    rows = [(i, t or "") for i, t in rows]
    texts = spark.createDataFrame([(t,) for i, t in rows if i is None] or [("",)], "t string")
    hashes = {r["t"]: r["h"] for r in texts.select("t", F.xxhash64("t").alias("h")).collect()}
    rows.sort(key=lambda r: hashes[r[1]] if r[0] is None else 0, reverse=True)
    rows.sort(key=lambda r: "" if r[0] is None else r[1], reverse=True)
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for at, (i, t) in enumerate(rows):
        nxt, n = rows[(at + 1) % len(rows)][1], len(t)
        edited = t[: n - n // 3] + nxt[: n // 3]
        a, b, c = S.signatures(t), S.signatures(edited), S.signatures(nxt)
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), S.fingerprint(a), S.fingerprint(b), S.jaccard(a, b), S.jaccard(a, c)))
    return sorted(out, key=str)


def test_edits_match_brute_force_across_buckets(spark):
    rows = [(i * 7 % 101, f"the word{i} and some other thing{i % 5} of text é{i}\nline " * (i % 6)) for i in range(101)]
    rows += [(3, "a second text of this id"), (3, "a second text of this id"), *[(None, f"no id {i}") for i in range(90)], (None, "no id 3"), (None, None), (500, ""), (501, None), (502, "x" * 200_000)]
    got = sorted((tuple(r) for r in S.fingerprint_edits(frame(spark, rows), bucket_rows=10).collect()), key=str)
    assert got == brute(spark, rows)


def test_one_row_and_no_rows(spark):
    r = S.fingerprint_edits(frame(spark, [(1, "the cat sat")])).first()
    assert r["near_next"] == 1.0 and r["n_chars"] == 11
    assert S.fingerprint_edits(frame(spark, [])).count() == 0


def test_fingerprints_are_sets_of_anchored_chains():
    a, b = S.signatures("The old cat and the young dog"), S.signatures("the OLD cat, and the young dog!")
    assert S.fingerprint(a) == S.fingerprint(b)
    assert (S.parse(S.fingerprint(a)) == a).all() and len(a) == 3
    assert len(S.signatures("")) == 0 and S.jaccard(S.signatures(""), S.signatures("")) == 1.0
    assert len(S.signatures("zug boot rad")) == 3
    assert S.jaccard(a[:1], a, 0.8) == 0.0


def test_pairs_match_brute_force(spark):
    base = [f"the w{i} of x{i} and y{i}" for i in range(40)]
    rows = [(0, " ".join(base)), (1, " ".join(base[:38])), (2, " ".join(base[10:])), (3, " ".join(base)), (4, "something else of all kinds"), (5, None), (6, " ".join(base[:36] + ["the q of r"]))]
    got = {(r["class_a"], r["class_b"], round(r["likeness"], 9)) for r in S.similar_pairs(frame(spark, rows)).collect()}
    sets = {i: S.signatures(t or "") for i, t in rows if i != 3}
    want = {(i, j, round(S.jaccard(a, b), 9)) for i, a in sets.items() for j, b in sets.items() if i < j and len(a) and len(b) and S.jaccard(a, b) >= 0.8}
    assert got == want and want
