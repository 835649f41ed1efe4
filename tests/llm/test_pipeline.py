import corpus_pipeline as C
from quillstone.llm.common import connected_components, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, labels):
    rows = [(i, t, g, s, len(t or "")) for i, t, g, s in docs]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def clean(i, seed):
    words = "the river ran past a small stone house where an old man read letters from his son in the evening light".split()
    out = [words[(i * 7 + k * seed + k * k) % len(words)] for k in range(90)]
    return " ".join(out).capitalize() + f". End {i}."


def test_stages_keep_clean_text_and_pack_everything(spark, tmp_path):
    docs = [(i, clean(i, 3 + i % 11), "en", f"s{i % 3}") for i in range(60)]
    docs += [(100, docs[5][1], "en", "s1"), (101, "### %%% @@@ !!! " * 60, "en", "s0"), (102, None, None, None), (103, "", "en", "s2")]
    write(spark, str(tmp_path), docs, [(i, 1, 0) for i in range(0, 60, 2)] + [(101, 0, 0)])
    stage_docs = table(spark, str(tmp_path), "documents")
    kept = C.quality(spark, stage_docs, str(tmp_path))
    ids = {r["doc_id"] for r in kept.collect()}
    assert set(range(60)) <= ids and 101 not in ids
    out = C.run(spark, str(tmp_path)).collect()
    assert out and {r["doc_id"] for r in out} <= ids - {100}
    assert len(C.STAGES) == 5 and C.ORACLE_SQL is None


def test_every_stage_takes_odd_rows_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(1, clean(1, 3), "en", "a"), (1, clean(1, 3), "en", "a"), (None, clean(2, 3), None, None), (2, None, "en", "a"), (3, "", None, "b"), (4, clean(4, 5) + "\n" + "word " * 40_000, "en", "b"), (5, " \t", "de", None)]
    extra = {"chunk": F.lit(1), "th": F.lit("t"), "keep": F.lit(True), "class_key": F.lit(2), "shard": F.lit("s"), "start": F.lit(0.5), "piece": F.lit("p"), "drop_th": F.lit(3), "own_th": F.lit(4), "drop_at": F.lit(5), "n_lines": F.lit(6)}
    docs = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], SCHEMA).withColumns(extra)
    names = docs.columns
    dedup = C.line_dedup(spark, docs, "")
    assert dedup.columns == names and dedup.count() == len(rows)
    single = C.near_duplicates(spark, docs, "")
    assert single.columns == names and sorted(str(r["doc_id"]) for r in single.collect()) == sorted(map(str, [1, None, 2, 3, 4, 5]))
    mixed = C.mixing(spark, docs, "")
    got = mixed.collect()
    assert mixed.columns == names and got and all(r["text"].strip() and r["n_chars"] == len(r["text"]) for r in got)
    packed = C.packing(spark, docs, "").collect()
    assert sorted(str(r["doc_id"]) for r in packed if r["piece"] == 0) == sorted(str(i) for i, *_ in rows)


def test_empty_documents(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    assert C.run(spark, str(tmp_path)).count() == 0


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[100 + i] for i in range(50)} == {100}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_a_stage_that_fails_leaves_no_files(spark, tmp_path, monkeypatch):
    import os
    from urllib.parse import urlparse

    import pytest

    from quillstone.llm import common

    folder = urlparse(common.shared_dir(spark)).path
    before = set(os.listdir(folder))
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def first(spark, docs, sf_dir):
        with common.owned("pipeline"):
            return common.materialize(docs, "first")

    def second(spark, docs, sf_dir):
        raise InterruptedError

    monkeypatch.setattr(C, "STAGES", [("first", first), ("second", second)])
    with pytest.raises(InterruptedError):
        C.run(spark, str(tmp_path))
    assert set(os.listdir(folder)) == before
