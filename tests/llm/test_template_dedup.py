import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quillstone.llm import template_dedup as T

P = T.TemplateParams(min_docs=3)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"n_chars": F.lit(7).cast("long"), "th": F.lit("x"), "at": F.lit(1), "template": F.lit(2), "leaf": F.lit("y")})


def brute(rows, p):
    """The template tree by its definition, over distinct texts."""
    first = {}
    for d, t in rows:
        if t is not None:
            k = (1 << 63) - 1 if d is None else d
            first[t] = min(k, first.get(t, k))
    lines = defaultdict(set)
    for t in first:
        for line in t.split("\n"):
            tokens = tuple(T.masked(line))
            if len(tokens) >= p.min_tokens:
                lines[tokens].add(t)
    leaves = defaultdict(list)
    for tokens in lines:
        leaves[len(tokens), tokens[: p.depth]].append(tokens)
    template = {}
    for leaf, members in leaves.items():
        cells = defaultdict(set)
        for m in members:
            for at, tok in enumerate(m):
                cells[at, tok] |= lines[m]
        for m in members:
            kept = tuple(tok if tok != T.WILD and len(cells[at, tok]) >= p.min_docs else T.WILD for at, tok in enumerate(m))
            fixed = sum(k != T.WILD for k in kept)
            ok = p.similarity * len(m) <= fixed < len(m) and sum(len(lines[x]) for x in members) >= p.min_docs and len(members) > 1 and min(len(lines[x]) for x in members) < p.min_docs
            template[m] = (leaf, kept) if ok else m
    texts = defaultdict(set)
    for m, ts in lines.items():
        texts[template[m]] |= ts
    recurring = {k: min(ts, key=lambda t: first[t]) for k, ts in texts.items() if len(ts) >= p.min_docs}
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0))
            continue
        kept = []
        for line in t.split("\n"):
            m = tuple(T.masked(line))
            k = template.get(m)
            if k not in recurring or recurring[k] == t:
                kept.append(line)
        out.append((d, "\n".join(kept), len(t.split("\n")) - len(kept)))
    return sorted(out, key=str)


ROWS = [(i, f"Body of text {chr(97 + i)} alone here\nPosted by user{i} on day {i}\nVisit our site for {['more', 'extra', 'much', 'great'][i % 4]} deals\n\nof\nBody closes {chr(97 + i)}{i} once") for i in range(8)]


def test_matches_brute_force(spark):
    rows = ROWS + [(50, None), (51, ""), (52, "a b"), (None, "Posted by user9 on day 77\nsolo line of none"), ROWS[2], (60, ROWS[3][1]), (61, "x\n" * 5000 + "Posted by user3 on day 4")]
    df = frame(spark, rows)
    got = T.dedup_lines(df, P)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    rows_got = got.collect()
    assert sorted(((r["doc_id"], r["text"], r["n_dropped"]) for r in rows_got), key=str) == brute(rows, P)
    assert all(r["n_chars"] == len(r["text"] or "") for r in rows_got)
    kept = [r["text"] for r in rows_got if r["text"] and "Posted by" in r["text"]]
    assert kept == [next(r["text"] for r in rows_got if r["doc_id"] == 0)]
    assert sum("Visit our site" in (r["text"] or "") for r in rows_got) == 1


def test_shuffled_and_broadcast_joins_agree(spark):
    rows = ROWS + [(50, None), (51, ""), ROWS[2], (61, "x\n" * 500 + "Posted by user3 on day 4")]
    small = T.TemplateParams(min_docs=3, broadcast_bytes=0)
    got = [sorted(map(str, T.dedup_lines(frame(spark, rows), p).collect())) for p in (P, small)]
    assert got[0] == got[1]


def test_copies_are_one_text_and_empty_table(spark):
    rows = [(i, "the same whole text\nof two lines here") for i in range(9)]
    assert {r["n_dropped"] for r in T.dedup_lines(frame(spark, rows), P).collect()} == {0}
    assert T.dedup_lines(frame(spark, []), P).count() == 0


def test_long_lines_recur_from_two_texts_and_short_ones_by_frequency(spark):
    twice = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(55))
    near = twice.split()[:30]
    rows = [(1, f"one\n{twice}\nAnd ornd."), (2, f"two\n{twice}\nAnd ornd."), (3, "three\n" + " ".join([*near[:25], "some", "thing", "else", "is", "here"]) + "\nAnd ornd."), (4, "four\n" + " ".join(near) + "\nAnd ornd.\nOf."), (5, "five\nAnd ornd.\nOf.\na line of three in two")]
    rows += [(6, "six\nOf.\na line of three in two"), (7, "seven\nOf.")]
    got = {r["doc_id"]: r["text"] for r in T.dedup_lines(frame(spark, rows)).collect()}
    assert [twice in got[i] for i in (1, 2)] == [True, False]
    assert got[3].count("\n") == 1 and got[4] == "four\nOf."  # one template, kept in the first text
    assert ["And ornd." in got[i] for i in range(1, 6)] == [True, False, False, False, False]
    assert all("Of." in got[i] for i in (4, 5, 6, 7)) and all("in two" in got[i] for i in (5, 6))


def test_several_variants_in_one_text_are_one_text(spark):
    letters = "pqrst"
    rows = [(1, "\n".join(f"a b c same w{x} z end" for x in letters)), *((i + 2, f"own {x}\na b c other{x} same z end") for i, x in enumerate(letters[:4]))]
    got = T.dedup_lines(frame(spark, rows), T.TemplateParams(min_docs=5)).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in got} == {1: 0, 2: 1, 3: 1, 4: 1, 5: 1}


def test_random_variants_within_and_across_texts(spark):
    r = random.Random(6)
    line = lambda: " ".join(["a", "b", r.choice("cd"), r.choice("efgh"), r.choice("ij"), r.choice("klmno"), "z"])
    rows = [(i, "\n".join(line() for _ in range(r.randint(1, 6)))) for i in range(25)]
    for p in (P, T.TemplateParams(min_docs=5, broadcast_bytes=0), T.TemplateParams(min_docs=8, similarity=0.4)):
        got = sorted(((x["doc_id"], x["text"], x["n_dropped"]) for x in T.dedup_lines(frame(spark, rows), p).collect()), key=str)
        assert got == brute(rows, p)


def test_a_text_is_not_split_once_for_each_of_its_lines(spark):
    docs = spark.createDataFrame([(i, f"the same long line of words here\nown {'x' * i} line") for i in range(8)], "doc_id long, text string")
    found = T.dedup_lines(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(" in plan and not re.search(r"lambdafunction\([^)]*split\(", plan)
    assert plan.count("split(text") == 1
    assert [r["text"] for r in found.orderBy("doc_id").collect()][1:] == [f"own {'x' * i} line" for i in range(1, 8)]


def test_lines_without_digits_are_not_masked_token_by_token(monkeypatch):
    assert T.masked("a1 b ²  c٣ 7") == [T.WILD, "b", "²", "c٣", T.WILD]
    monkeypatch.setattr(T, "_DIGITS", None)
    assert T.masked(" a  b² c٣ ") == ["a", "b²", "c٣"]
