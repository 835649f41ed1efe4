import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import url_trust as U

URLS = [
    None, "", "no scheme", "http://A.Example.COM/en/712?x#y", "https://x.com/en/1", "https://com/en/", "http://xcom/en/", "http://e.example.net/de/81", "http://e.example.net/de/79", "ftp://h.org?/es/1",
    "http://h.org/es/a/b#c", "http://example.com/en/7", "http://notexample.com/en/7", "http://é.COM/En/1", "a://b://c.com/en/x", "http://", "http:///en/", "http://h.example.net/de/8?z", "http://u\nv.com/en/",
]


def brute(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max((r.name for r in fits), key=len, default=None)


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "rule": F.lit("r"), "trust": F.lit(9), "src": F.lit("s"), "score": F.lit(1)})


def test_hosts_paths_and_rules(spark):
    got = {r["page_id"]: r for r in U.judge_urls(frame(spark, [(i, u, None) for i, u in enumerate(URLS)])).collect()}
    verdicts = {r.name: r.verdict for r in U.RULES}
    for i, url in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == brute(url), url
        if got[i]["rule"]:
            assert got[i]["verdict"] == verdicts[got[i]["rule"]]
    assert got[0]["verdict"] == "allow"


def test_distrust_follows_links_backwards(spark):
    link = lambda *hosts: "".join(f'<a class="x" href="https://{h}/p">t</a>' for h in hosts)
    rows = [
        (1, "http://good.net/de/1", link("fine.example")), (2, "http://fine.example/x", link("good.net")), (3, "http://ring.example/x", link("cheap-pills.example", "cheap-pills.example", "RING.example")),
        (4, "http://cheap-pills.example/x", ""), (5, "http://far.example/x", link("ring.example")), (6, "http://lone.example/x", None), (6, "http://lone.example/x", None),
    ]
    bad = spark.createDataFrame([("Cheap-Pills.example", "block"), ("nowhere.example", "allow"), (None, "block")], "host string, verdict string")
    got = {(r["page_id"], r["verdict"]) for r in U.judge_urls(frame(spark, rows), seeds=bad).collect()}
    assert {r["verdict"] for r in U.judge_urls(frame(spark, rows)).collect()} == {"allow"}  # nothing known is bad
    assert got == {(1, "allow"), (2, "allow"), (3, "block"), (4, "block"), (5, "block"), (6, "allow")}
    assert U.judge_urls(frame(spark, [])).count() == 0


def test_propagation_is_personalised_pagerank(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "a", 1), ("c", "d", 3), ("d", "a", 1), ("e", "a", 1)]
    p = U.TrustParams(steps=200, tolerance=1e-12)
    df = spark.createDataFrame(edges, "src string, dst string, n long")
    got = {r["host"]: r["score"] for r in U.propagate(df, spark.createDataFrame([("a", 1.0), ("e", 3.0)], "host string, weight double"), U.TrustParams(steps=60, tolerance=1e-6), "test").collect()}
    names = sorted({x for s, d, _ in edges for x in (s, d)})
    out = {s: sum(n for x, _, n in edges if x == s) for s, _, _ in edges}
    m = np.zeros((5, 5))
    for s, d, n in edges:
        m[names.index(d), names.index(s)] = n / out[s]
    seed = np.array([0.25, 0, 0, 0, 0.75])
    want = np.linalg.solve(np.eye(5) - p.damping * m, (1 - p.damping) * seed)
    assert [got.get(n, 0.0) for n in names] == pytest.approx(want.tolist(), abs=1e-4)


def test_distrust_reaches_far_hosts_from_seeds_without_pages(spark):
    link = lambda host: f'<a href="https://{host}/p">t</a>'
    rows = [(0, "http://h0.example/x", link("cheap-pills.example"))] + [(i, f"http://h{i}.example/x", link(f"h{i - 1}.example")) for i in range(1, 45)]
    rows += [(100 + i, f"http://warez.s{i}.example/x", None) for i in range(20)]
    bad = spark.createDataFrame([(h, "block") for h in ("cheap-pills.example", *(f"warez.s{i}.example" for i in range(20)))], "host string, verdict string")
    got = {r["page_id"]: r["verdict"] for r in U.judge_urls(frame(spark, rows), seeds=bad).collect()}
    # host i is i + 1 links away: 0.85 ** 42 > 0.001 > 0.85 ** 43
    assert [got[i] for i in range(45)] == ["block"] * 42 + ["allow"] * 3
    assert {got[100 + i] for i in range(20)} == {"block"}


def test_rules_seed_distrust_without_any_given_seed(spark):
    rows = [(1, "http://bad.org/es/1", ""), (2, "http://near.example/x", '<a href="//bad.org/es/1">t</a>'), (3, "http://far.example/x", None), (4, "http://good.net/de/1", '<a href=http://ok.example/>'), (5, "http://ok.example/", '<a href="http://bad.org/">t</a>')]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.judge_urls(frame(spark, rows)).collect()}
    assert got == {1: ("org/es/", "block"), 2: (None, "block"), 3: (None, "allow"), 4: ("net/de/", "allow"), 5: (None, got[5][1])}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<a href="/p?q#r">t</a><a href=\'b\'>', ["http://h.example/p?q#r", "http://h.example/d/b"]),
        ('<base href="https://B.example/x/"><a href="y">', ["https://B.example/x/y"]),
        ("<A title='>' HREF = //c.example/z >t<area href=http://d.example>", ["http://c.example/z", "http://d.example"]),
        ('<!-- <a href="http://no.example"> --><script>"<a href=http://no.example>"</script><a href="mailto:x@y"><a name=href>', []),
        ('<a href="http://e.example/?a=1&amp;b=2"><abbr href="http://no.example"><a data-href="http://no.example">', ["http://e.example/?a=1&b=2"]),
        ('<a href="http://[">x</a><a href="  http://f.example/ ">', ["http://f.example/"]),
        ("<a", []), (None, []), ("<!-- open <a href=http://no.example>", []),
    ],
)
def test_links_are_resolved(page, want):
    assert U.links("http://h.example/d/e", page) == want


def test_links_take_time_in_proportion_to_the_page():
    start = time.perf_counter()
    for page in ("<a x" * 60_000, "<a x='" * 60_000, '<a href="' * 60_001, "<a x=\"<a x=\">" * 30_000, "<script>" * 60_000, "<!--" * 60_000, "<a " + " " * 60_000, "<a href=" * 60_000, "<a '" * 60_000):
        U.links("http://h.example/", page)
    assert time.perf_counter() - start < 20


def test_quotes_count_after_an_equals_sign_only():
    page = """<a title=it's href=/a>x</a> <a x='>' href="/b?x='">y</a> <a data-x="<a href='/no'>" href=/c>z</a> <a ' href=/d> <a href=/e unending"""
    assert U.links("http://h.example/p", page) == ["http://h.example/a", "http://h.example/b?x='", "http://h.example/c", "http://h.example/d"]
