"""The cleaning of nested work records on rows that meet every step."""

import json

from quillstone.operators.works import COLUMNS, WorkRules, clean_works


def row(k, **given):
    base = dict.fromkeys(COLUMNS, "") | {"id": f"W{k}", "publication_year": "2015", "authors": f"A{k}", "cited_by_count": "3"}
    return {"k": k} | base | given


TOPIC = json.dumps({"display_name": "T", "subfield": {"display_name": "S"}, "field": {"display_name": "F"}, "domain": {"display_name": "D"}})
KEYS = lambda *names: json.dumps([{"display_name": n, "score": 0.25} for n in names])
ROWS = [
    row(1, title="Growth & Trade", doi="https://doi.org/10.1/a", author_institutions="short", keywords=KEYS("k1", "k2"), primary_topic=TOPIC, journal="J"),
    row(2, title="", display_name="Growth, Trade", doi="10.1/b", author_institutions="the longest one", keywords=KEYS("k2", "k3", "k4", "k5"), abstract_inverted_index=json.dumps({"JEL": [3], "codes:": [4], "C10,": [5], "D20": [6], "<b>Some</b>": [0], "long": [1], "text.": [2]})),
    row(3, title="growth & trade", doi="10.1/c"),
    row(4, title="Growth Trade", authors=" ", doi="10.1/d", author_institutions="longer than the longest one"),
    row(5, title="Growth Trade", doi="10.1/a", author_institutions="not as long"),
    row(6, title="Alone", authors="", concepts=json.dumps([{"display_name": "c0", "level": 0}, {"display_name": "c1", "level": 1}])),
    row(7, title="Erratum: x"), row(8, title=" ", display_name=None), row(9, title="Blocked"), row(10, title="Exact Title "), row(11, title="***"),
    row(12, title="Human Capital and Growth"), row(13, title="Human Capital and Growth", publication_year="2014"), row(14, title="Nobody", authors=""), row(15, title="Nobody", authors=None),
]


def test_every_step(spark):
    rules = WorkRules(blocked={"id": ["w9"]}, titles=("exact title",), renamed=(("Human Capital and Growth", 2015, "Human Capital and Growth 2015"),), versions=2)
    df = spark.createDataFrame([tuple(r.values()) for r in ROWS], ", ".join(f"`{c}` {'int' if c == 'k' else 'string'}" for c in ROWS[0])).repartition(3)
    got = {r["works_title"]: r.asDict() for r in clean_works(df, "k", rules).collect()}
    assert sorted(got) == ["Alone", "Growth Trade", "Human Capital and Growth", "Human Capital and Growth 2015", "growth trade"]
    g = got["Growth Trade"]
    assert (g["works_tag"], g["works_id"], g["works_authors"], g["works_journal"]) == (1, "W1", "A1", "J")
    assert (g["works_doi_1"], g["works_doi_2"], g["works_more_dois"]) == ("10.1/a", "10.1/b", "")
    assert g["works_author_institutions"] == "the longest one" and g["works_abstract"] == "Some long text." and g["works_codes"] == "C10; D20"
    assert g["works_keywords"] == "k1 (0.250); k2 (0.250); k3 (0.250); k4 (0.250); k5 (0.250)" and g["works_top3_keywords"] == "k1 (0.250); k2 (0.250); k3 (0.250); k4 (0.250)"
    assert [g[f"works_primary_{x}"] for x in ("domain", "field", "subfield", "topic")] == ["D", "F", "S", "T"]
    assert (got["Alone"]["works_tag"], got["Alone"]["works_authors"], got["Alone"]["works_level0_concepts"]) == (0, "", "c0")
    few = clean_works(df, "k", WorkRules(versions=1)).where("works_title = 'Growth Trade'").first()
    assert (few["works_doi_1"], few["works_more_dois"]) == ("10.1/a", "10.1/b")
    assert clean_works(df.limit(0), "k").count() == 0
