"""Every registered reference query against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillstone.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cells(df):
    df = df[sorted(df.columns)]

    def text(v):
        if v is None or str(v) in ("<NA>", "NaT", "nan"):
            return "~"
        if isinstance(v, float) or getattr(getattr(v, "dtype", None), "kind", "") == "f":
            return "~" if math.isnan(v) else f"{float(v):.8g}"
        return str(v)

    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL) - {"tfidf_multilabel_lr"}))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).limit(1).count() == 1


def test_text_from_inverted_index_is_the_title(spark):
    got = {r["doc_id"]: r["text"] for r in registry.queries()["inverted_index_text"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        assert got[r["doc_id"]] == " ".join((r["text"] or "").split())


def test_tfidf_model_beats_chance_out_of_fold(spark):
    rows = registry.queries()["tfidf_multilabel_lr"](spark, SF).toPandas()
    own = rows[rows["label"] == "quality"]
    good, bad = own.loc[own["truth"].astype(int) == 1, "score"].to_numpy(), own.loc[own["truth"].astype(int) == 0, "score"].to_numpy()
    above = (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2  # area under the curve; most labels are 1, so accuracy says little
    assert above > 0.7


def test_tfidf_model_has_bigrams_the_references_vocabulary_and_five_folds(spark, monkeypatch):
    from quillstone.plans import classifying

    tfidf, met = classifying.T.tfidf_arrays, {}

    def vectors(df, row, text, **params):
        out = tfidf(df, row, text, **params)
        met.update(params, words=[r["term"] for r in out[1].collect()])
        return out

    def fitted(data, features, labels, folds, strengths):
        met.update(folds=data.select("fold").distinct().count(), models=len(labels) * len(folds), features=features)
        raise InterruptedError

    monkeypatch.setattr(classifying.T, "tfidf_arrays", vectors)
    monkeypatch.setattr(classifying.J, "fit_all", fitted)
    with pytest.raises(InterruptedError):
        registry.queries()["tfidf_multilabel_lr"](spark, SF)
    assert met["vocabulary"] == 50_000 and any(" " in w for w in met["words"]) and met["features"] == len(met["words"])
    assert met["folds"] == 5 and met["models"] == 10


def test_embedding_model_scores_every_row(spark):
    rows = registry.queries()["embedding_lr"](spark, SF)
    assert sorted(r["vec_id"] for r in rows.collect()) == sorted(r["vec_id"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect())
