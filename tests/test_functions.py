import pytest
from pyspark.sql import functions as F

from quillstone.functions import checks, columns, text
from quillstone.operators import authorship, classify, concentration, consolidate, linkage, names, scoring


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_text_cleaning(spark):
    assert one(spark, text.clean_text(F.col("a")), a="  a b \n c ") == "a b c"
    assert one(spark, text.clean_text(F.col("a")), a=None) == ""
    assert one(spark, text.clean_markup(F.col("a")), a="<b>NULL</b>") == ""
    assert one(spark, text.unescape(F.col("a")), a="&amp;amp;lt;") == "<"
    assert one(spark, text.to_ascii(F.col("a")), a="Müller-Łuć") == "Muller-uc"
    assert one(spark, text.clean_title(F.col("a")), a="A paper * ") == "A paper"
    assert one(spark, text.clean_title(F.col("a")), a="A paper Open Access") == "A paper"
    assert one(spark, text.title_key(F.col("a"), "spaced"), a="R&D &amp; Growth: ö") == "r and d and growth ö"
    assert one(spark, text.title_key(F.col("a"), "compact"), a="R & D ½") == "rd½"
    assert one(spark, text.title_key(F.col("a"), "ascii"), a="Öl-Preis 2") == "l preis 2"
    with pytest.raises(ValueError):
        text.title_key(F.col("a"), "other")


@pytest.mark.parametrize(
    ("variant", "raw", "key"),
    [
        ("works", "https://doi.org/10.1/A", "10.1/A"), ("works", "https://dx.doi.org/10.1/A", "https://dx.doi.org/10.1/A"), ("prefix", "doi:10.1/A", "10.1/a"),
        ("all", "http://dx.doi.org/10.1/a.;", "10.1/a"), ("papers", "https://doi.org/doi:10.1/a,", "10.1/a"), ("records", "HTTPS://DX.DOI.ORG/10.1/a.", "10.1/a"),
    ],
)
def test_doi_variants(spark, variant, raw, key):
    assert one(spark, text.doi_key(F.col("a"), **text.DOI_VARIANTS[variant]), a=raw) == key


def test_names_years_codes(spark):
    first, last = text.first_last(F.col("a"))
    assert (one(spark, first, a="Ann B. Lee, Jr."), one(spark, last, a="Ann B. Lee, Jr.")) == ("Ann", "Lee")
    assert (one(spark, first, a="Plato"), one(spark, last, a="Plato")) == ("", "Plato")
    assert one(spark, text.reverse_comma(F.col("a")), a="Lee, Ann, B.") == "Ann, B. Lee"
    assert one(spark, text.year_in(F.col("a")), a="pub 1999, 2004") == "1999"
    assert one(spark, text.year_in(F.col("a"), last=True), a="pub 1999, 2004") == "2004"
    assert one(spark, text.year_in(F.col("a"), last=True), a="none") == ""
    assert one(spark, text.month_in(F.col("a")), a="March or January") == 1
    assert one(spark, F.array_join(text.code_letters(F.col("a")), ""), a="g12, D01; G3 A") == "GDA"
    assert one(spark, text.is_not_paper(F.col("a")), a="A REPLY to X") is True
    assert one(spark, text.inverted_index_text(F.col("a")), a='{"b":[1],"a":[0,2]}') == "a b a"
    assert one(spark, text.whole(F.col("a")), a="2015.0") == 2015
    assert one(spark, text.whole(F.col("a")), a="x") is None
    assert one(spark, text.common_substring_length(F.col("a"), F.col("b")), a="smithson", b="smiths") == 6
    assert one(spark, text.sequence_ratio(F.col("a"), F.col("b")), a="abcd", b="bcde") == pytest.approx(0.75)


def test_columns(spark):
    assert one(spark, columns.first_nonblank(F.col("a"), F.col("b")), a=" ", b=" x ") == "x"
    assert one(spark, F.to_json(columns.split_cell(F.col("a"), distinct=True)), a=" x;;y ; x") == '["x","y"]'
    df = spark.createDataFrame([("1; 2", "a")], "l string, r string")
    assert [tuple(r) for r in columns.explode_parallel(df, "l", "r", ("p", "q")).collect()] == [(1, "1", "a"), (2, "2", "")]
    assert columns.add_prefix(spark.createDataFrame([(1, 2)], "a int, s_b int"), "s_").columns == ["s_a", "s_b"]
    assert columns.pad_columns(df, ["l", "z"]).first()["z"] == ""
    assert columns.drop_columns(df, ["r", "none"]).columns == ["l"]
    assert columns.order_columns(df, ["r", "none"]).columns == ["r", "l"]
    with pytest.raises(ValueError):
        columns.keep_columns(df, ["none"])
    with pytest.raises(ValueError):
        checks.assert_unique(df.union(df), ["l"])
    assert columns.versions(spark.createDataFrame([(["x"],)], "v array<string>"), "v", "d", 2).select("d1", "d2").first() == ("x", "")


def test_concentration_by_hand(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 3.0), (3, 2.0), (4, 1.0)], "author_id int, publication_credit double")
    r = concentration.summary(df).first()
    assert (r["n_authors"], r["total_credit"], r["top_10pct_share"]) == (4, 10.0, 0.4)
    assert r["hhi"] == pytest.approx(0.3)
    assert r["gini"] == pytest.approx(2 * (1 * 1 + 2 * 2 + 3 * 3 + 4 * 4) / 40 - 5 / 4)
    zero = concentration.summary(df.withColumn("publication_credit", F.lit(0.0))).first()
    assert (zero["hhi"], zero["gini"], zero["top_1pct_share"]) == (0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        concentration.credit("half")


def test_top_authors_keep_ties(spark):
    counts = spark.createDataFrame([(2000, a, c) for a, c in ((1, 5), (2, 3), (3, 3), (4, 1))], "y int, author int, c long")
    got = authorship.top_authors(counts, [50]).collect()
    assert sorted(r["author"] for r in got) == [1, 2, 3]


def test_t_quantiles():
    assert authorship.t_quantile(1) == pytest.approx(12.706204736, abs=1e-6)
    assert authorship.t_quantile(10) == pytest.approx(2.228138852, abs=1e-8)
    assert authorship.t_quantile(40) == pytest.approx(2.021075390, abs=1e-8)


def test_linkage_skips_ambiguous_keys_until_later(spark):
    left = spark.createDataFrame([(1, "a", "t1"), (2, "a", "t2"), (3, "", "t3")], "l long, k string, t string")
    right = spark.createDataFrame([(9, "a", "t2"), (8, "b", "t9"), (7, "", "t3")], "r long, k string, t string")
    got = {(x["l"], x["r"], x["strategy"]) for x in linkage.staged_link(left, right, ("l", "r"), [("k", "k", "k"), ("t", "t", "t")]).collect()}
    assert got == {(2, 9, "t"), (3, 7, "t"), (1, None, "left_only"), (None, 8, "right_only")}


def test_consolidation_ties(spark):
    df = spark.createDataFrame([("k", 1, "aa"), ("k", 2, "bb"), ("k", 3, "c")], "key string, ord int, v string")
    assert consolidate.consolidate(df, "key", ["v"], "ord").first()["v"] == "aa"
    assert df.groupBy("key").agg(consolidate.longest_greatest("v").alias("v")).first()["v"] == "bb"
    assert df.groupBy("key").agg(consolidate.first_nonblank("v", "ord").alias("v")).first()["v"] == "aa"


def test_components_of_a_chain_and_ids(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(20)] + [("x", "y")], "a string, b string")
    got = {r["node"]: r["component"] for r in names.components(edges).collect()}
    assert {got[f"n{i:02}"] for i in range(21)} == {"n00"} and got["y"] == "x"
    ids = names.exact_groups(spark.createDataFrame([("b",), ("a",), ("",), ("ab",)], "key string"), "key").collect()
    assert {r["key"]: r["exact_id"] for r in ids} == {"a": "AEX000001", "ab": "AEX000002", "b": "AEX000003", "": ""}


def test_greedy_matching_is_one_to_one(spark):
    left = spark.createDataFrame([("p", 1, "smith"), ("p", 2, "smiths")], "g string, l_id int, l_name string")
    right = spark.createDataFrame([("p", 5, "smiths"), ("p", 6, "jones")], "g string, r_id int, r_name string")
    assert [(r["l_id"], r["r_id"]) for r in names.greedy_overlap(left, right, "g").collect()] == [(1, 5)]


def test_resolution_decisions(spark):
    kind = "subject int, profile string, institution string, year int, confidence double, seq int"
    evidence = spark.createDataFrame(
        [(1, "a", "X", 1990, 0.95, 1), (2, "a", "X", None, 0.9, 2), (3, "a", "X", 1990, 0.9, 3), (3, "b", "Y", 1991, 0.85, 4), (4, "a", "", 1990, 0.7, 5), (5, "a", "X", 1990, 0.5, 6), (7, "a", "X", 1990, 0.9, 7), (7, "a", "Y", 1990, 0.9, 8)], kind
    )
    subjects = spark.createDataFrame([(i, 1, False) for i in range(1, 8)] + [(8, 0, False)], "subject int, candidates int, truncated boolean")
    got = {r["subject"]: r["reason"] for r in scoring.resolve(evidence, subjects).collect()}
    assert got == {1: "clear_record", 2: "year_not_public", 3: "competing_profiles", 4: "record_missing_institution", 5: "below_threshold", 6: "profiles_without_record", 7: "profile_conflicts", 8: "no_profile"}


def test_votes(spark):
    votes = spark.createDataFrame([(1, "m1", "A", 1.0, 0.5), (1, "m2", "B", 1.0, 0.5), (1, "m3", "B", 0.5, 0.1), (2, "m1", "A", 1.0, 0.9), (2, "m2", "B", 1.0, 0.2)], "row int, model string, label string, weight double, confidence double")
    assert {r["row"]: r["label"] for r in classify.vote_single(votes).collect()} == {1: "B", 2: "A"}
    assert {r["row"]: (r["labels"], r["how"]) for r in classify.vote_multi(votes, 1.5).collect()} == {1: ("B", "vote"), 2: ("A", "best model")}


def test_inverted_indexes_are_made_in_their_rows(spark):
    import json

    texts = ["b a b", "", "a", "x y x y x", "é É é \\"] + [" ".join(f"w{i * i % 37}" for i in range(3_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    made = df.select("id", text.inverted_index(F.filter(F.split("t", r"\s+"), lambda x: x != "")).alias("index"))
    back = made.select("id", "index", text.inverted_index_text(F.col("index")).alias("text"))
    assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()
    for r in back.collect():
        want = {}
        for i, w in enumerate(texts[r["id"]].split()):
            want.setdefault(w, []).append(i)
        assert json.loads(r["index"]) == want and r["text"] == texts[r["id"]]
