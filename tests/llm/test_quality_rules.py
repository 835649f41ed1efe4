"""The rules against a plain reading of their definition, odd rows, and SQL on the smallest table."""

import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from quillstone.llm.quality_rules import RULES, STOP_WORDS, Rule, RuleParams, judge_rules, rules_sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = "the cat and a dog sat on this old mat for " + " ".join(f"word{i}" for i in range(50))
TEXTS = [
    None, "", " \t\n", "a a a a", "one two three one two three", PLAIN, PLAIN + "\n" + PLAIN, "the of and " * 40, "x y z " * 3 + PLAIN, "# $ " * 30 + PLAIN,
    "\n".join(["the same line"] * 9 + [PLAIN]), "the same line \nthe same line\r\nthe same line\n\n\nthe same line", "straße 日本語 \U0001f600  x " * 20, "THE!! END!! " * 30,
    "- the first\n- the second\n" * 30, "and so on ...\nthe rest of it…\n" * 20, "1 2 3 4 5 6 7 8 9 " * 7 + "the",
]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text, rules=RULES):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(windows)
    stop = {x for words in STOP_WORDS.values() for x in words}
    m = {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({i + j for i, x in enumerate(windows) if times[x] > 1 for j in range(3)}), "n_unlettered": sum(not any(c.isalpha() for c in x) for x in w),
        "n_shouted": sum(x.endswith(("!!", "??")) for x in w), "n_stop_words": sum(x.lower() in stop for x in w),
        "n_broken_lines": sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in lines), "n_listed_lines": sum(bool(re.match(r"[\x20\x09-\x0D]*[-*•][\x20\x09-\x0D]", x)) for x in lines),
    }
    base = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
    failed = [r.name for r in rules if (r.least is not None and 100 * m[r.measure] < r.least * m[r.per]) or (r.most is not None and 100 * m[r.measure] > r.most * m[r.per])]
    return m | {"base_failed": base, "failed_rules": failed, "kept": not base and not failed}


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_measures_and_verdicts_are_those_of_the_definition(spark):
    got = rows(judge_rules(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")))
    for i, text in enumerate(TEXTS):
        want = brute(text)
        assert {k: got[i][k] for k in want} == want, text
    assert got[5]["kept"] and not got[7]["kept"] and got[9]["failed_rules"] == ["symbols", "words without letters"]
    assert {r.name for r in RULES} >= {x for i in got for x in got[i]["failed_rules"]}


def test_rows_of_sql_on_the_fixture(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [*enumerate(TEXTS), (5, TEXTS[5]), (None, TEXTS[6])])
    docs = spark.createDataFrame([*enumerate(TEXTS), (5, TEXTS[5]), (None, TEXTS[6])], "doc_id long, text string")
    want = con.execute(rules_sql()).fetchall()
    got = [tuple(r) for r in judge_rules(docs).select("doc_id", *MEASURES[:4], "n_repeat_words", "base_failed", "kept").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_very_long_text_counts_whole(spark):
    text = " ".join(f"w{i % 70_000}" for i in range(210_000)) + "\nend"
    (r,) = judge_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r["n_words"], r["n_repeat_words"], r["base_failed"]) == (210_001, 210_000, True)
    alone = " ".join(f"w{i}" for i in range(150_000))
    (r,) = judge_rules(spark.createDataFrame([(1, alone)], "doc_id long, text string")).collect()
    assert (r["n_words"], r["n_repeat_words"], r["base_failed"]) == (150_000, 0, False)


def test_clashing_columns_repeated_rows_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, PLAIN), (1, PLAIN), (None, None)], "doc_id long, text string")
    docs = docs.withColumns({"n_words": F.lit("mine"), "Kept": F.lit(7), "_words": F.lit("w"), "a.b": F.lit(1), "_marks": F.lit(2)})
    out = judge_rules(docs)
    assert out.columns[:5] == ["doc_id", "text", "_words", "a.b", "_marks"] and len(set(map(str.lower, out.columns))) == len(out.columns)
    assert sorted((str(r["doc_id"]), r["n_words"], r["kept"], r["_words"]) for r in out.collect()) == [("1", 61, True, "w"), ("1", 61, True, "w"), ("None", 0, False, "w")]
    assert judge_rules(docs.limit(0)).count() == 0


def test_a_table_of_ones_own(spark):
    p = RuleParams(rules=(Rule("few stop words", "n_stop_words", "n_words", least=90),), least_words=2, stop_words=("x",))
    got = rows(judge_rules(spark.createDataFrame([(1, "x x x"), (2, "x y z"), (3, "x")], "doc_id long, text string"), p))
    assert [(got[i]["kept"], got[i]["failed_rules"]) for i in (1, 2, 3)] == [(True, []), (False, ["few stop words"]), (False, [])]
    assert all(r["kept"] == (r["n_words"] > 1) for r in judge_rules(spark.createDataFrame([(1, "x y"), (2, "")], "doc_id long, text string"), RuleParams(rules=(), least_words=2)).collect())


def test_no_python_and_no_shuffle_in_the_plan(spark):
    plan = judge_rules(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
