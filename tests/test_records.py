"""Records, dates, codes and ensembles on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from quillstone.functions import records, text
from quillstone.operators import classify, concentration, ensemble


def one(spark, column, a):
    return spark.createDataFrame([(a,)], "a string").select(column.alias("x")).first()["x"]


def test_dates(spark):
    a = F.col("a")
    assert one(spark, records.date_year(a), '{"issued":{"date-parts":[["2011"]]},"created":{"date-parts":[[1999]]}}') == 2011
    assert one(spark, records.date_year(a), "no json") is None
    assert one(spark, records.date_text(a, "issued"), '{"issued":{"date-parts":[[2011,3]]}}') == "2011-03"
    assert one(spark, records.date_or_blank(a), "31/31/2000") == ""
    assert one(spark, records.likely_year(a, 2027), "in 2099 or 1999") == ""
    assert one(spark, records.year_from_path(a), "/x/1999/w_2003_v12345.jsonl") == 2003


def test_names_and_walk(spark):
    a = F.col("a")
    assert one(spark, records.scored_names(a), '[{"display_name":"x","score":0.5},{"score":1},{"display_name":"y"}]') == "x (0.500); y"
    assert one(spark, records.scored_names(a), "{}") == "" and one(spark, records.scored_names(a), None) == ""
    assert one(spark, records.first_json_value(a), '["u","v"]') == "u" and one(spark, records.first_json_value(a), "plain") == "plain"
    df = spark.createDataFrame([(1, json.dumps({"a": [1, {"b": None}], "c": "d"})), (2, "bad {"), (3, "7")], "id int, j string")
    got = {(r["id"], r["path"], r["value"]) for r in records.walk(df, "j", ["id"]).collect()}
    assert {(1, "$.a[0]", "1"), (1, "$.c", "d"), (3, "$", "7")} <= got and len(got) == 5
    with pytest.raises(Exception):  # noqa: B017
        records.walk(df, "j", ["id"], depth=1).collect()


def test_codes_and_abstracts(spark):
    a = F.col("a")
    assert one(spark, text.announced_codes(a), "JEL Classification: d12, G10 / e31. A99") == ["D12", "G10", "E31"]
    assert one(spark, text.nearby_codes(a), "The jel list says: use (C33) then B20") == ["C33", "B20"]
    assert one(spark, text.clean_abstract(a, label=True), "<p>Abstract: A &amp;lt; b. JEL codes: A12; rest") == "A < b. ; rest"
    assert one(spark, text.has_code(a, F.lit("B2")), "A1; B2") and not one(spark, text.has_code(a, F.lit(" ")), "A1; ")


def test_negative_values_have_no_gini(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,)], "publication_credit double")
    with pytest.raises(Exception, match="Gini"):
        concentration.summary(df).collect()


def test_sublinear_weights_by_hand(spark):
    import math

    docs = spark.createDataFrame([(1, "apple apple pear"), (2, "pear plum"), (3, "apple plum plum plum")], "id int, t string")
    rows, model = classify.tfidf(docs, "t", n=1, min_df=1, max_df=0.99)
    words = model.stages[0].vocabulary
    got = {r["id"]: dict(zip([words[i] for i in r["features"].indices], r["features"].values, strict=True)) for r in rows.collect()}
    idf = {w: math.log(4 / (df + 1)) + 1 for w, df in {"apple": 2, "pear": 2, "plum": 2}.items()}
    raw = {"apple": (1 + math.log(2)) * idf["apple"], "pear": idf["pear"]}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert got[1] == pytest.approx({w: v / norm for w, v in raw.items()})


def test_ensemble_votes(spark):
    df = spark.createDataFrame([(1, "A; B", 0.4, "B", 0.8), (2, "", 0.9, "C", 0.2), (3, "A", 0.5, "B", 0.5), (4, "", 0.1, "", 0.2)], "id int, x_prediction string, x_confidence double, y_prediction string, y_confidence double")
    weights = ensemble.weight_grid(spark, {"x": [1.0, 2.0], "y": [1.0]})
    got = {(r["config"], r["row"]): (r["labels"], round(r["confidence"], 9)) for r in ensemble.weighted_labels(ensemble.long_votes(df, "id", ["x", "y"]), weights).collect()}
    assert got[1, 1] == ("B", 0.6) and got[1, 2] == ("C", 0.2) and got[1, 3] == ("B", 0.5)
    assert got[2, 1] == ("A; B", round((0.4 + (0.8 + 0.8) / 3) / 2, 9)) and got[2, 3] == ("A", 0.5) and (1, 4) not in got


def test_stratified_split_sizes(spark):
    df = spark.range(107).selectExpr("id", "if(id < 100, 'a', if(id < 106, 'b', 'c')) s")
    got = {(r["s"], r["part"]): r["count"] for r in ensemble.stratified_split(df, "s", "id").groupBy("s", "part").count().collect()}
    assert got == {("a", "test"): 20, ("a", "train"): 80, ("b", "test"): 1, ("b", "train"): 5, ("c", "train"): 1}
