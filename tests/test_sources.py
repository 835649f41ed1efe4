import gzip
import json

import pytest
from pyspark.sql import functions as F

from quillstone.sources import files, html_meta, redif, rest
from quillstone.streaming import events


def test_csv_keeps_blanks_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"a ""b""\nc"\n2,\n3,NA\n')
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", 'a "b"\nc'), ("2", ""), ("3", "NA")]
    assert files.read_csv_with_nulls(spark, str(tmp_path / "a.csv")).where("id = 3").first()["t"] == ""
    files.write_csv(df, str(tmp_path / "out"), one_file=True)
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, df.collect()))


def test_tsv_and_odd_delimiters(spark, tmp_path):
    (tmp_path / "a.tsv").write_bytes("a\tb\nx\"\té\n".encode("latin-1"))
    assert files.read_tsv(spark, str(tmp_path / "a.tsv")).first() == ('x"', "é")
    with gzip.open(tmp_path / "a.txt.gz", "wt", encoding="utf-8") as f:
        f.write("1¿¬x¿y¬\n")
    assert files.read_delimited(spark, str(tmp_path / "a.txt.gz"), ["a", "b"], "¿", "¬").first() == ("1", "x¿y")


def test_jsonl_combine_and_sink(spark, tmp_path):
    (tmp_path / "w2001.jsonl").write_text('{"id":"a","v":1}\n\n{"id":"","v":2}\n')
    (tmp_path / "w2000.jsonl").write_text('{"id":"a","v":3}\n{"id":"","v":4}\n')
    df = files.read_jsonl(spark, str(tmp_path), strict=True).withColumn("y", F.regexp_extract(F.input_file_name(), r"w(\d+)", 1))
    got = files.combine_jsonl(df, "id", F.col("y"), F.col("v"))
    assert sorted((r["id"], r["v"]) for r in got.collect()) == [("", 2), ("", 4), ("a", 3)]
    files.write_jsonl(got.select("id"), str(tmp_path / "out"), "2024-01-01")
    assert {r["collection_date"] for r in spark.read.json(str(tmp_path / "out")).collect()} == {"2024-01-01"}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, str(tmp_path / "bad"), df.select("id", "v").schema).collect()


def test_year_partitions(spark, tmp_path):
    df = spark.createDataFrame([("H1", 1999, 1), ("h1 ", 1999, 2), ("H2", 2000, 3), ("H3", 1900, 4)], "handle string, year int, ord int")
    counts = files.write_by_year(df, str(tmp_path / "o"), ["handle"], "year", 1950, 2026, [F.col("ord")])
    assert {r["year"]: (r["read"], r["duplicates"], r["written"]) for r in counts.collect()} == {1999: (2, 1, 1), 2000: (1, 0, 1)}
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    assert files.find_files(spark, str(tmp_path / "o"), (".parquet",)).count() >= 2


def test_redif(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.rdf").write_text("Template-Type: x\nAuthor-Name: A\nAuthor-Name: B\nTitle: one\n two\nnot a field\n: no name\n\nTitle: next\n")
    rows = sorted(redif.read_redif(spark, str(tmp_path)).collect(), key=lambda r: r["record"])
    assert rows[0]["fields"] == {"template_type": "x", "author_name": "A; B", "title": "one two"}
    assert rows[1]["fields"] == {"title": "next"}


def test_rest_source_and_retries(spark, tmp_path):
    (tmp_path / "j-2000-0.json").write_text(json.dumps([{"id": "a"}]))
    (tmp_path / "j-2000-1.json").write_text(json.dumps([{"id": "b"}]))
    spark.dataSource.register(rest.WorksSource)
    df = spark.read.format("works").option("fixtures", str(tmp_path)).option("sources", "j").option("from", "2000").option("to", "2001").load()
    assert sorted(r["id"] for r in df.collect()) == ["a", "b"]
    answers, waits = iter([(429, {"Retry-After": "7"}, {}), (503, {}, {}), (200, {}, {"ok": 1})]), []
    assert rest.fetch(lambda u, p: next(answers), "u", {}, sleep=waits.append) == {"ok": 1}
    assert waits == [7.0, 2.0]
    with pytest.raises(ValueError):
        rest.fetch(lambda u, p: (404, {}, {}), "u", {})


def test_html_metadata():
    page = '<html lang="en"><head><title> A  B </title><meta name="citation_author" content="X Y"><meta name="citation_author" content="Z"><meta name="description" content="d"></head><h1>H</h1>'
    got = html_meta.metadata(page)
    assert (got["title"], got["authors"], got["abstract"], got["h1"], got["lang"]) == ("A B", "X Y; Z", "d", "H", "en")


def test_stream_equals_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.0, "2024-01-01 00:10:00"), (2, "a", 2.0, "2024-01-01 00:50:00"), (3, "b", 4.0, "2024-01-01 03:00:00")], "user_id int, event_type string, value double, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = events.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("quillstone_windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("quillstone_windows").collect())) == sorted(map(tuple, events.windowed_counts(df).collect()))
    assert events.sessions(df).count() == 3
