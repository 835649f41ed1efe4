"""Collectors, sinks and the command line without a network."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone import cli
from quillstone.sources import collect, files, html_meta, rest, sinks


def test_downloads_and_mirrors(tmp_path):
    calls = []
    get = lambda u: calls.append(u) or b"x"
    assert collect.download("u", str(tmp_path / "a/b"), get) and not collect.download("u", str(tmp_path / "a/b"), get)
    assert calls == ["u"] and (tmp_path / "a/b").read_bytes() == b"x"
    assert collect.mirror("s", "t", lambda args: 23) == 23
    with pytest.raises(RuntimeError):
        collect.mirror("s", "t", lambda args: 12)


PAGES = {
    "http://j.example/issues": '<a href="/issue/1">1</a><a href="http://j.example/issue/2">2</a><a href="/about">a</a>',
    "http://a.example/1": "<title>One</title>",
    "http://b.example/1": '<title>One</title><div class="abstract">Found <b>it</b>.</div><p>JEL codes: C10, D20</p>',
}


def test_crawls_resume_and_fall_back(spark):
    pages = dict(PAGES)

    def client():  # a local function travels to the workers by value
        return lambda url: (200, pages[url]) if url in pages else (404, "")

    urls = spark.createDataFrame([("http://j.example/issues",), ("http://gone.example/",)], "url string")
    got = collect.crawl_pages(collect.pending_urls(urls, urls.limit(0)), client)
    assert {r["status"] for r in got.collect()} == {200, 404}
    assert collect.pending_urls(urls, urls.where("url like '%gone%'")).count() == 1
    assert {r["url"] for r in collect.linked_pages(got, "/issue/").collect()} == {"http://j.example/issue/1", "http://j.example/issue/2"}
    dois = spark.createDataFrame([("10.1", ["http://a.example/1", "http://b.example/1", "http://never.example"]), ("10.2", ["http://a.example/1"]), ("10.3", [])], "doi string, urls array<string>")
    rows = {r["doi"]: r for r in collect.first_metadata(dois, client).collect()}
    assert (rows["10.1"]["url"], rows["10.1"]["abstract"], rows["10.1"]["codes"], rows["10.1"]["tried"]) == ("http://b.example/1", "Found it.", "C10; D20", 2)
    assert (rows["10.2"]["title"], rows["10.2"]["abstract"]) == ("One", "") and rows["10.3"]["tried"] == 0


def test_selectors_only_where_no_meta_tag():
    got = html_meta.metadata('<meta name="citation_author" content="A"><div class="authors">B</div><ul id="keywords"><li>k1<li>k2</ul>')
    assert (got["authors"], got["keywords"]) == ("A", "k1k2")


def test_no_page_stops_the_parser():
    got = html_meta.metadata('<![foo[bar]]><title>T</title><![CDATA[x]]><![if gte]><h1>H</h1><div class="abstract">A</div><!x><?y>')
    assert (got["title"], got["h1"], got["abstract"]) == ("T", "H", "A")
    start = time.perf_counter()
    for page in ("<b>" * 60_000 + "</i>" * 60_000, '<div class="abstract">' * 3_000 + "x" * 100, "<i><b>" * 30_000 + "</i>" * 30_000, "<a x" * 60_000):
        html_meta.metadata(page)
    assert time.perf_counter() - start < 20
    assert html_meta.metadata("<title>T</title> <b unending")["title"] == "T"


def test_transports(tmp_path):
    times, waits = iter([0.0, 0.0, 1.0, 1.0]), []
    call = rest.paced(lambda u, p: (200, {}, {"n": 1}), 3.0, clock=lambda: next(times), sleep=waits.append)
    call("u", {}), call("u", {})
    assert waits == [2.0]
    seen = []
    kept = rest.cached(lambda u, p: seen.append(u) or ((200, {}, {"u": u}) if u == "good" else (500, {}, {})), str(tmp_path / "c"))
    assert [kept("good", {})[2], kept("good", {})[2], kept("bad", {})[0], kept("bad", {})[0]] == [{"u": "good"}, {"u": "good"}, 500, 500]
    assert seen == ["good", "bad", "bad"]


def from_options(options):
    body = json.loads(options["body"])
    return lambda url, params: (200, {}, {"results": [x | {"y": params["year"]} for x in body], "meta": {}})


def test_named_transport_and_doi_dedup(spark):
    spark.dataSource.register(rest.WorksSource)
    options = {"transport": "test_collect:from_options", "body": json.dumps([{"id": "a"}, {"id": "b"}]), "sources": "j", "from": "2000", "to": "2001"}
    reader = rest.WorksReader(options)
    assert sorted(r[2] for p in reader.partitions() for r in reader.read(p)) == ["a", "a", "b", "b"]
    df = spark.createDataFrame([(1, "https://doi.org/10.1/A"), (2, "10.1/a"), (3, ""), (4, None), (5, "10.2")], "n int, doi string")
    assert sorted(r["n"] for r in rest.first_by_doi(df, F.col("doi"), [F.col("n")]).collect()) == [1, 3, 4, 5]


def test_bad_lines_are_named(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"x"}\n\n{"id":\n')
    with pytest.raises(ValueError, match="a.jsonl, line 3"):
        files.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    (tmp_path / "b.jsonl").write_text('{"id":"x"}\r\n\n{"id":"y"}\n')
    assert sorted(r["id"] for r in files.read_jsonl(spark, str(tmp_path / "b.jsonl")).collect()) == ["x", "y"]


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_of_split_files_keep_their_numbers(spark, tmp_path, small_splits):
    want = {}
    for name, n in (("a", 400), ("b", 3), ("c", 150)):
        lines = ["" if i % 7 == 3 else json.dumps({"id": f"{name}{i}", "pad": "é" * (i % 40)}) for i in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
        want |= {(f"{name}.jsonl", i + 1): x for i, x in enumerate(lines)}
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10  # a file is read by several tasks
    got = {(r["file"].rpartition("/")[2], r["line"]): r["text"] for r in files.numbered_lines(spark, str(tmp_path)).collect()}
    assert got == want
    assert files.read_jsonl(spark, str(tmp_path)).where("id IS NOT NULL").count() == sum(bool(x) for x in want.values())
    text = (tmp_path / "a.jsonl").read_text().split("\n")
    text[311], text[390] = '{"id": oops', "{"
    (tmp_path / "a.jsonl").write_text("\n".join(text))
    assert files.bad_json_line(spark, str(tmp_path))[1] == 312
    with pytest.raises(ValueError, match="a.jsonl, line 312"):
        files.read_jsonl(spark, str(tmp_path))


def test_side_schema(spark, tmp_path):
    (tmp_path / "s.txt").write_text("¬paper¬¿text\nname¿text\n\n", encoding="utf-8")
    assert files.side_schema(spark, str(tmp_path / "s.txt")) == ["paper", "name"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2001, 0.5, "a"), (2000, 0.25, "b"), (2002, None, "a")], "y int, v double, g string")
    sinks.write_report({"Shares": df.orderBy("y"), "Note": "text"}, str(tmp_path / "r/report.txt"))
    assert (tmp_path / "r/report.txt").read_text().splitlines()[:4] == ["Shares", "------", "y     v     g", "2000  0.25  b"]
    sinks.write_vectors(spark.createDataFrame([(2, [1.0, 2.0]), (1, [3.0, 4.0])], "k int, v array<double>"), "k", "v", str(tmp_path / "m.npy"))
    assert np.load(tmp_path / "m.npy").tolist() == [[3.0, 4.0], [1.0, 2.0]] and json.loads((tmp_path / "m.npy.keys.json").read_text()) == [1, 2]
    sinks.write_chart(df, "y", "v", str(tmp_path / "c.html"), "Top <share>", sinks.scope_subtitle((2000, 2002), 20), by="g")
    page = (tmp_path / "c.html").read_text()
    assert "Top &lt;share&gt;" in page and '{"b": [[2000.0, 0.25]], "a": [[2001.0, 0.5]]}' in page and "http" not in page
    with pytest.raises(ValueError):
        sinks.write_report({"x": df}, str(tmp_path / "x"), most=2)


def test_command_line(tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "staged_link" in capsys.readouterr().out
    (tmp_path / ".env").write_text('# c\nexport KEY="v 1"\nOTHER=2\nOLD=3\n')
    env = {"OLD": "kept"}
    assert cli.load_settings(str(tmp_path / ".env"), ["KEY", "OLD"], env) == {"KEY": "v 1"} and env == {"OLD": "kept", "KEY": "v 1"}
    (tmp_path / "bad").write_text("nothing\n")
    with pytest.raises(ValueError, match="line 1"):
        cli.load_settings(str(tmp_path / "bad"), [], {})
    (tmp_path / "a.py").write_text("")
    with pytest.raises(FileNotFoundError):
        cli.run_steps([str(tmp_path / "a.py"), str(tmp_path / "no.py")])
    with pytest.raises(RuntimeError):
        cli.run_steps([str(tmp_path / "a.py")], lambda args: 1)
    assert cli.run_steps([str(tmp_path / "a.py")], lambda args: 0) == [str(tmp_path / "a.py")]
