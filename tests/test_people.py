"""Names, identifiers and filters against plain Python."""

import difflib
import html
import re
import unicodedata

import pytest
from pyspark.sql import functions as F
from test_queries import SF, pytestmark  # noqa: F401

from quillstone.functions import people
from quillstone.operators import crosswalk, filters, linkage, names
from quillstone.plans import registry


def test_promotions_and_parts(spark):
    rows = [("A. Mary Lee", "A", "Lee"), ("A Lee", "A", "Lee"), ("A B Lee", "A", "Lee"), ("Mary Lee B", "Mary", "B"), ("Mary B", "Mary", "B"), ("", "", ""), (None, None, None), ("A, Mary", "A", "Mary")]
    df = spark.createDataFrame(rows, "author string, first string, last string")
    got = df.select(people.promoted_first(F.col("author"), F.col("first"), F.col("last")), people.promoted_last(F.col("author"), F.col("first"), F.col("last"))).collect()
    assert [tuple(r) for r in got] == [("Mary", "Lee"), ("A", "Lee"), ("A", "Lee"), ("Mary", "Lee"), ("Mary", "B"), ("", ""), (None, None), ("A", "Mary")]
    one = spark.createDataFrame([("Lee, Jr. and Jr Smith",)], "a string").select(people.without_junior(F.col("a")), people.display_name(F.lit("J. Ö. O'Neil-3 x")), people.name_part(F.lit(" a.b, c ")))
    assert tuple(one.first()) == ("Lee and Smith", "J O O Neil x", "ab c")


LIKE = [  # first, last, candidate, (family likeness, given likeness or None where it doesn't count)
    ("Mary", "Lee", "Lee, Mary", (1.0, 1.0)), ("Mary", "Lee", "M. Lee", (1.0, 0.82)), ("Mary", "Lee", "Marylou Lee", (1.0, 0.9)), ("Mary", "Lee", "Mary Leeds", (0.9, 1.0)),
    ("Mary", "Lee", "Xyz Quo", (0.0, None)), (None, "Müller", "Muller", (1.0, 0.0)), ("Mary", "van der Berg", "Mary Ann vander Berg", (0.9, 1.0)), ("Mary", "Lee", "Lee", (1.0, 0.0)),
    ("Ann", "Lee", "Lee, Maria, Anna", (1.0, 0.9)), ("Marta", "Lee", "Maria Lee", (1.0, 0.8)), ("Marta", "Lee", "Maria M Lee", (1.0, 0.82)), ("", "Lee", "Lee", (1.0, 0.0)), ("Maria", "Lee", "Li, Maria", (0.4, None)),
    ("Kate", "Andersson", "Kate Anderson", (2 * 8 / 17, 1.0)), ("Al", "Lee", ", Al", (0.9, 1.0)), ("J", "Lee", "Jo Lee", (1.0, 0.82)),
]


def test_person_similarity_by_its_definition(spark):
    none = [("Mary", None, "x"), ("a", "b", ""), ("a", "b", None), ("a", "123", "b")]
    df = spark.createDataFrame([(i, *x[:3]) for i, x in enumerate([*LIKE, *none])], "i int, first string, last string, candidate string")
    got = {r["i"]: r["s"] for r in people.with_person_similarity(df, F.col("first"), F.col("last"), F.col("candidate"), "s").collect()}
    want = [round(0.68 * a if b is None else 0.68 * a + 0.32 * b, 4) for *_, (a, b) in LIKE] + [0.0] * len(none)
    assert [got[i] for i in range(len(want))] == want


def test_person_similarity_query_compares_neighbours(spark):
    parts = {r["p_partkey"]: r["p_name"].lower().split() for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    rows = registry.queries()["person_similarity"](spark, SF).collect()
    assert len(rows) == len(parts) - 1
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    for r in rows:
        (*_, last), (*others, family) = parts[r["p_partkey"]], parts[r["p_partkey"] + 1]
        near = 1.0 if last == family else 0.9 if last in family or family in last else ratio(last, family)
        assert r["similarity"] <= 1.0 and (r["similarity"] == round(0.68 * near, 4) if near < 0.72 else r["similarity"] >= round(0.68 * near, 4))


def test_folded_names_equal_plain_python(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in registry.queries()["folded_names"](spark, SF).collect():
        title = (texts[r["doc_id"]] or "").split("\n")[0]
        for _ in range(3):
            title = html.unescape(title)
        assert r["ascii_title"] == unicodedata.normalize("NFKD", title).encode("ascii", "ignore").decode()


def test_similar_pairs_equal_all_pairs(spark):
    rows = [(f"{last}_{first}", first, last) for last in ("lee", "may") for first in ("catherine", "catharine", "katherine", "cath", "kathe", "c", "catherina", "anna", "anne", "hannah", "")]
    got = {(r["key_a"], r["key_b"]): r["ratio"] for r in names.similar_pairs(spark.createDataFrame(rows, "key string, first string, last string"), 0.8).collect()}
    want = {}
    for ka, fa, la in rows:
        for kb, fb, lb in rows:
            if la == lb and ka < kb and min(len(fa), len(fb)) >= 4 and fa[0] == fb[0]:
                ratio = difflib.SequenceMatcher(None, fa, fb).ratio()
                if ratio >= 0.8:
                    want[ka, kb] = ratio
    assert got == want and want


def greedy(lefts, rights, least):
    def overlap(x, y):
        best = max((len(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1) if x[i:j] in y), default=0)
        return best / max(len(x), len(y), 1)

    out, free = [], dict(rights)
    for i, name in sorted(lefts):
        scored = sorted((-overlap(name, other), j) for j, other in free.items())
        if scored and -scored[0][0] >= least:
            out.append((i, scored[0][1]))
            del free[scored[0][1]]
    return out


def test_three_passes_equal_plain_python(spark):
    left = [(1, "d", "lee", "ann"), (2, "d", "may", "bob"), (3, "d", "smithson", "x"), (4, "e", "solo", "y"), (5, "d", "jon", "z")]
    right = [(11, "d", "lee", "ann"), (12, "d", "may", "rob"), (13, "d", "smithsen", "q"), (14, "f", "other", "w"), (15, "d", "jones", "v"), (16, "d", "zzz", "u")]
    a = spark.createDataFrame(left, "l_id long, doi string, last string, first string")
    b = spark.createDataFrame(right, "r_id long, doi string, last string, first string")
    got = {tuple(r) for r in linkage.three_pass_outer(a, b, "doi", ("last", "first"), 0.6).select("l_id", "r_id", "strategy").collect()}
    third = greedy([(3, "smithson"), (5, "jon")], [(13, "smithsen"), (15, "jones"), (16, "zzz")], 0.6)
    want = {(1, 11, "first_pass"), (2, 12, "second_pass"), (4, None, "left_only"), (None, 14, "right_only"), (None, 16, "right_only")} | {(i, j, "overlap") for i, j in third}
    assert got == want and len(third) == 2


def test_components_that_do_not_settle_are_an_error(spark):
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)], "a string, b string")
    assert {r["component"] for r in names.components(chain).collect()} == {"n000"}
    with pytest.raises(RuntimeError):
        names.components(chain, rounds=2)


def test_staged_link_plan_grows_with_the_stages_only(spark):
    rows = spark.range(20).selectExpr("id", *[f"cast(id % {k + 3} as string) k{k}" for k in range(6)])
    left, right = rows.where("id % 2 = 0").withColumnRenamed("id", "a"), rows.where("id % 2 = 1").withColumnRenamed("id", "b")
    sizes = []
    for n in (2, 4, 6):
        out = linkage.staged_link(left, right, ("a", "b"), [(f"s{k}", f"k{k}", f"k{k}") for k in range(n)])
        sizes.append(len(re.findall("Relation|Range", out._jdf.queryExecution().optimizedPlan().toString())))
    assert max(sizes) <= 2


def test_positions_and_keys_are_asserted(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "i int, p string"), spark.createDataFrame([(1, "u")], "i int, p string")
    with pytest.raises(ValueError):
        linkage.zip_by_position({"a": a, "b": b}, "i")
    assert linkage.zip_by_position({"a": a, "b": a}, "i").columns == ["i", "a_p", "b_p"]
    with pytest.raises(ValueError):
        linkage.join_chain(a, [a.union(b)], "i")


def test_filters(spark):
    df = spark.createDataFrame([("a; b", "Suggested by X", "", "only"), ("c", None, "10.1", "only"), (None, "y", None, "both")], "cell string, note string, doi string, status string")
    got = df.select(filters.has_any(F.col("cell"), ["b", "z"]), filters.mentions("suggested BY", F.col("note"), F.col("cell"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (False, False)]
    assert filters.drop_unlinked_without_key(df, "status", "only", "doi").count() == 2
    assert [r["c"] for r in df.select(filters.domain_order(F.col("status"), ["both"]).alias("c")).collect()] == [2, 2, 1]
    kept = filters.kept_in_order(spark.createDataFrame([("a", 2), ("a", 1), ("", 3), (None, 4)], "k string, o int"), "k", "o")
    assert sorted(r["o"] for r in kept.collect()) == [1, 3, 4]


def test_longest_values_differ_in_ties(spark):
    df = spark.createDataFrame([("bb", 1), ("cc", 2), (" a ", 3), (None, 4)], "v string, o int")
    assert tuple(df.agg(crosswalk.longest_first("v", "o"), crosswalk.longest_greatest("v")).first()) == ("bb", "cc")


def test_author_rows_meet_their_names_once(spark, tmp_path):
    from quillstone.operators import crosswalk
    from quillstone.plans import people as plans

    spark.createDataFrame([(i // 4, i % 4 + 1, i % 6) for i in range(200)], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, f"{a} {b}") for i, (a, b) in enumerate([("ann", "lee"), ("al", "lee"), ("bo", "kim"), ("cy", "roy"), ("di", "roy"), ("ed", "kim")])], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    rows = plans._author_rows(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count() == 200 and plan.count("Join ") == 2  # the parts, and the names
    plain = plans._name_rows(spark, str(tmp_path)).join(rows.select("ord", "author_id", "author_group_method"), "ord")
    want = {r["ord"]: r["manual_review_reasons"] for r in crosswalk.review_flags(plain).collect()}
    assert {r["ord"]: r["manual_review_reasons"] for r in rows.collect()} == want
    order = ["last", "first", "author_id", "doi_full"]
    few = crosswalk.review_extract(rows, order, order, 200, 20)
    assert few.rdd.getNumPartitions() == 10
    assert [tuple(r) for r in few.collect()] == [tuple(r) for r in crosswalk.review_extract(rows, order, order).collect()]
