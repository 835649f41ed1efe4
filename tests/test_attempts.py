"""Work that is killed and goes on, crawls, fallbacks, and collections that restart and keep one pace."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tests import fake_net

from quillstone.sources import attempts, collect, pace, rest


def frame(spark, n, parts=2):
    return spark.range(n).select(F.col("id").alias("k")).repartitionByRange(parts, "k")


def test_a_killed_run_goes_on_without_loss_or_copies(spark, tmp_path):
    path, calls = str(tmp_path / "log"), str(tmp_path / "calls")
    how = {"work": "tests.fake_net:squares", "calls": calls, "dies_at": "37"}
    with pytest.raises(Exception):  # noqa: B017  the worker's process dies in the middle of its task
        attempts.run(frame(spark, 60), path, "k", **how)
    before = [int(u) for u, _ in fake_net.calls(calls)]
    kept = {int(r["key"]) for r in attempts.read_log(spark, path).collect()}
    assert 37 not in kept and 30 <= len(kept) < 60 and kept == set(before)
    (tmp_path / "alive").write_text("")
    got = attempts.run(frame(spark, 60), path, "k", **how)
    assert {int(r["key"]): json.loads(r["result"])["square"] for r in got.collect()} == {i: i * i for i in range(60)}
    assert sorted(int(u) for u, _ in fake_net.calls(calls)) == list(range(60))  # nothing was worked on twice
    assert got.count() == 60 and {(r["status"], r["attempts"], r["errors"]) for r in got.collect()} == {("done", 1, "")}
    attempts.run(frame(spark, 60), path, "k", **how)
    assert len(fake_net.calls(calls)) == 60


def test_a_line_that_was_cut_off_is_no_record(spark, tmp_path):
    attempts.run(frame(spark, 3, 1), str(tmp_path), "k", work="tests.fake_net:squares", calls=str(tmp_path / "calls"))
    (part,) = tmp_path.glob("part-*.jsonl")
    text = part.read_text()
    (tmp_path / "draft-x.jsonl").write_text(text.replace('"0"', '"7"').replace('"1"', '"8"')[: len(text) - 9])
    part.unlink()
    assert sorted(r["key"] for r in attempts.read_log(spark, str(tmp_path)).collect()) == ["7", "8"]
    (tmp_path / "part-y.jsonl").write_text(text[:-9])
    with pytest.raises(Exception, match="bad record in part-y"):
        attempts.read_log(spark, str(tmp_path)).collect()


def test_failed_rows_are_tried_again_and_keep_their_errors(spark, tmp_path):
    rows = spark.createDataFrame([(-1,), (2,), (2,), (None,)], "k int")
    how = {"work": "tests.fake_net:squares", "calls": str(tmp_path / "calls")}
    run = lambda **x: {r["key"]: r for r in attempts.run(rows, str(tmp_path / "log"), "k", **how, **x).collect()}
    got = run(tries=2, most=5)
    assert set(got) == {"-1", "2"} and (got["-1"]["status"], got["-1"]["attempts"], got["-1"]["result"]) == ("failed", 2, None)
    assert run(again=False)["-1"]["attempts"] == 2
    got = run(tries=2, most=5)["-1"]
    assert got["attempts"] == 4 and got["errors"] == "; ".join(["ValueError: below zero: -1"] * 4)
    assert run(tries=2, most=4)["-1"]["attempts"] == 4  # as many as the policy allows
    assert len(fake_net.calls(str(tmp_path / "calls"))) == 5


def test_another_schema_version_is_an_error(spark, tmp_path):
    how = {"work": "tests.fake_net:squares", "calls": str(tmp_path / "calls")}
    attempts.run(frame(spark, 2), str(tmp_path / "log"), "k", **how)
    with pytest.raises(Exception, match="schema version 2 here, but a record of version 1"):
        attempts.run(frame(spark, 3), str(tmp_path / "log"), "k", version=2, **how)
    with pytest.raises(Exception, match="only appended"):
        frame(spark, 2).write.format("attempts").mode("overwrite").options(path=str(tmp_path / "log")).save()


def test_tries_wait_longer_each_time_and_results_may_name_errors():
    waits, answers = [], iter([KeyError("a"), attempts.WorkError(["u: 1", "u: 2"]), {"x": 1, "_errors": ["late"]}])

    def work(row):
        if isinstance(x := next(answers), Exception):
            raise x
        return x

    got = attempts.outcome(work, Row(k="5", attempts=1, errors="old"), "k", 4, 1, sleep=waits.append, pause=2.0)
    assert waits == [2.0, 4.0] and (got["attempts"], got["errors"], got["result"]) == (4, "old; KeyError: 'a'; u: 1; u: 2; late", '{"x": 1}')


ARTICLE = '<title>T{n}</title><meta name="citation_author" content="A{n}"><div class="abstract">About {n}.</div>'


def test_a_crawl_from_lists_to_rows_goes_on_where_it_failed(spark, tmp_path):
    pages = {
        "http://j.example/issues": '<a href="/issue/1">1</a> <a href="/issue/2">2</a> <a href="/about">x</a> <a href="/issue/1">again</a>',
        "http://j.example/issue/1": '<a href="../article/1">a</a><a href="http://j.example/article/2">b</a>', "http://j.example/issue/2": "500",
        "http://j.example/article/1": ARTICLE.format(n=1), "http://j.example/article/2": ARTICLE.format(n=2), "http://j.example/article/3": ARTICLE.format(n=3),
    }
    (tmp_path / "pages").write_text(json.dumps(pages))
    how = {"issue": "/issue/", "article": "/article/", "client": "tests.fake_net:client", "pages": str(tmp_path / "pages"), "calls": str(tmp_path / "calls")}
    starts = spark.createDataFrame([("http://j.example/issues",)], "url string")
    run = lambda: {r["url"]: r for r in collect.crawl_articles(starts, str(tmp_path / "log"), **how).collect()}
    got = run()
    assert {u.rpartition("/")[2]: (r["title"], r["authors"], r["abstract"]) for u, r in got.items()} == {"1": ("T1", "A1", "About 1."), "2": ("T2", "A2", "About 2.")}
    pages["http://j.example/issue/2"] = '<a href="/article/3">c</a><a href="/article/4">gone</a>'
    (tmp_path / "pages").write_text(json.dumps(pages))
    got = run()
    assert {u.rpartition("/")[2]: r["status"] for u, r in got.items()} == {"1": "done", "2": "done", "3": "done", "4": "failed"}
    assert "status 404" in got["http://j.example/article/4"]["errors"]
    asked = [u for u, _ in fake_net.calls(str(tmp_path / "calls"))]
    assert asked.count("http://j.example/article/1") == 1 and asked.count("http://j.example/issues") == 1 and asked.count("http://j.example/issue/2") == 2


def test_fallbacks_join_their_errors(spark, tmp_path):
    (tmp_path / "pages").write_text(json.dumps({"a": "<title>One</title>", "b": ARTICLE.format(n=2), "bad": "500"}))
    rows = [("10.1", ["gone", "a", "b", "never"]), ("10.2", ["a", "gone"]), ("10.3", []), ("10.4", ["gone", "bad"]), ("10.5", None)]
    got = collect.fallback_metadata(spark.createDataFrame(rows, "doi string, urls array<string>"), str(tmp_path / "log"), "tests.fake_net:client", pages=str(tmp_path / "pages"), calls=str(tmp_path / "calls"))
    got = {r["doi"]: r for r in got.collect()}
    assert (got["10.1"]["url"], got["10.1"]["abstract"], got["10.1"]["errors"]) == ("b", "About 2.", "ConnectionError: gone: status 404")
    assert (got["10.2"]["url"], got["10.2"]["title"], got["10.2"]["status"]) == ("a", "One", "done")
    assert got["10.4"]["errors"] == "ConnectionError: gone: status 404; ConnectionError: bad: status 500" and got["10.4"]["status"] == "failed"
    assert got["10.3"]["errors"] == got["10.5"]["errors"] == "no address"


def works(spark, tmp_path, **more):
    spark.dataSource.register(rest.WorksSource)
    return {"transport": "tests.fake_net:transport", "calls": str(tmp_path / "calls"), "sources": "j,k", "from": "2000", "to": "2001"} | more


def test_a_stream_of_pages_restarts_at_its_cursor(spark, tmp_path):
    options = works(spark, tmp_path, pages="2", fails=str(tmp_path / "down"))
    stream = spark.readStream.format("works").options(**options).load()

    def collected(stop_after=None):
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start()
        try:
            while query.isActive and (stop_after is None or len(query.recentProgress) < stop_after):
                if stop_after is None and query.recentProgress and len(fake_net.calls(options["calls"])) >= 12 and not query.status["isDataAvailable"]:
                    query.processAllAvailable()
                    break
                query.awaitTermination(0.2)
            if stop_after is None:
                query.processAllAvailable()
        finally:
            query.stop()

    collected(stop_after=2)
    first = len(fake_net.calls(options["calls"]))
    assert 0 < first <= 12
    collected()
    ids = [r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(ids) == len(set(ids)) == 2 * 2 * 3 * 2
    # a batch that was not committed is asked for again, and no other page
    assert len(fake_net.calls(options["calls"])) <= 12 + 4


def test_offsets_replay_the_same_pages(spark, tmp_path):
    reader = rest.WorksStream(works(spark, tmp_path, pages="4"))
    at, rows = reader.initialOffset(), []
    assert json.loads(json.dumps(at)) == at
    while True:
        more, after = reader.read(at)
        more = list(more)
        assert list(reader.readBetweenOffsets(at, after)) == more
        if after == at:
            break
        rows, at = rows + more, after
    assert at == {"unit": 4, "cursor": "*"} and len({r[2] for r in rows}) == len(rows) == 24


def test_all_partitions_keep_one_pace(spark, tmp_path):
    options = works(spark, tmp_path, seconds="0.25", lanes="3")
    df = spark.read.format("works").options(**options).load()
    assert df.rdd.getNumPartitions() == 3 and df.count() == 24
    times = [t for _, t in fake_net.calls(options["calls"])]
    assert len(times) == 12 and times[-1] - times[0] >= 11 * 0.25 - 0.1
    assert min(b - a for a, b in zip(times, times[1:], strict=False)) > 0.1  # each call has a slot of its own


def test_slots_are_never_shared():
    for now in (0.0, 3.2, 7.0, 7.01, 1e9 + 0.3):
        slots = [pace.next_slot(now, 2.0, lane, 4, 1.5) for lane in range(4)]
        assert all(s >= now for s in slots) and len({round((s - 2.0) / 1.5, 3) for s in slots}) == 4 and all(((s - 2.0) / 1.5) % 1 < 1e-6 or ((s - 2.0) / 1.5) % 1 > 1 - 1e-6 for s in slots)
    clock, waits = iter([0.0, 0.0, 0.0, 0.5, 0.5, 0.5]), []
    call = pace.in_lane(lambda u: (200, {}, {}), 0.0, 0, 2, 1.0, clock=lambda: next(clock), sleep=waits.append)
    call("a"), call("b")
    assert waits == [1.5]


def test_a_token_goes_into_the_headers_and_not_into_the_cache_key(tmp_path):
    seen = []
    base = lambda url, params, *headers: seen.append((params, *headers)) or (200, {}, {"n": len(seen)})
    a = rest.with_token(rest.cached(base, str(tmp_path / "c")), "one")("u", {"q": "1"})
    b = rest.with_token(rest.cached(base, str(tmp_path / "c")), "two")("u", {"q": "1"})
    assert a == b and seen == [({"q": "1"}, {"Authorization": "Bearer one"})]
