import time

import pytest
from pyspark.sql import functions as F

from quillstone.llm import html_extract as H


def main(html):
    blocks, _ = H.split_zones(H.parse(html))
    return None if blocks is None else "\n".join(blocks)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<nav>menu</nav><article><h1>T &amp; U</h1><p>a<b>b</b> c\n d<br>e<p>next</article><footer>f</footer>", "T & U\nab c d e\nnext"),
        ('<article><p>x</p><aside>side</aside><div class="ad">buy</div><section id="comments"><article class="comment"><p>c</p></article></section><p>y</article>', "x\ny"),
        ("<main><script>if(a<b)</script><style>p{}</style><p>x</p><form><p>name</p></form></main>", "x"),
        ("<article><header><h2>Head</h2><p>by me</p></header><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></article>", "Head\nby me\na\nb\n1\n2"),
        ('<body class="has-sidebar"><div id="content"><p>x</p><div class="share-buttons">s</div></div><div>other</div>', "x"),
        ("<article><p>&nbsp;a&#233;&nbsp; b &lt;i&gt; </p><!-- no --><p> </p></article", "aé b <i>"),
        ('<article><p hidden>no</p><p style="display: none">no</p><p>yes</p><div role="alert">no</div></article>', "yes"),
        ("<article></article>", ""),
        ('<ARTICLE><P CLASS="Lead">Up</P></ARTICLE>', "Up"),
    ],
)
def test_main_text(html, text):
    assert (main(html) or "") == text


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "page": F.lit(1), "marks": F.lit("m"), "text": F.lit("t"), "at": F.lit(2)})


def brute(rows, run):
    """Tokens that lie in a substring of ``run`` tokens that another page of the host has."""
    pages = {}
    for i, url, html in rows:
        host = url.split("://")[1].split("/")[0].lower() if url and "://" in url else ""
        pages[i, url, html] = (host, *H.split_zones(H.parse(html or "")))
    out = []
    for key in rows:
        host, blocks, rest = pages[key]
        if blocks is not None:
            out.append((key[0], "\n".join(blocks)))
            continue
        others = set()
        for k, (h, _, r) in pages.items():
            if k != key and h == host:
                t = [x for text, _ in r for x in text.split()]
                others |= {tuple(t[i : i + run]) for i in range(len(t) - run + 1)}
        t = [x for text, _ in rest for x in text.split()]
        gone = {i + k for i in range(len(t) - run + 1) if tuple(t[i : i + run]) in others for k in range(run)}
        at, kept = 0, []
        for text, is_open in rest:
            own = text.split()
            left = [w for i, w in enumerate(own, at) if i not in gone]
            at += len(own)
            if is_open and left:
                kept.append(" ".join(left))
        out.append((key[0], "\n".join(kept)))
    return sorted(out, key=str)


def test_suffix_array_removes_what_a_hosts_pages_share(spark):
    notice = "we use small files on this site to see who you are and more"
    rows = [(i, f"http://H.example/{i}", f"<div>{notice}</div><div>own{i} words{i} page{i} only{i}</div><div>{notice} or not</div>") for i in range(6)]
    rows += [(10, "http://other.example/", f"<div>{notice}</div>"), (11, None, f"<p>{notice}"), (12, "http://h.example/a", "<nav>n</nav><article>kept kept " + notice + "</article>"), (13, "http://h.example/b", None), (14, "x", "")]
    got = H.extract(frame(spark, rows), H.ExtractParams(run=5)).collect()
    assert sorted(((r["page_id"], r["text"]) for r in got), key=str) == brute(rows, 5)
    assert {r["text"] for r in got if r["page_id"] == 3} == {"own3 words3 page3 only3"}
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_repeated_rows_are_one_page_and_empty_table(spark):
    row = (1, "http://a.example/", "<div>one two three four five six seven eight nine ten</div>")
    assert {r["text"] for r in H.extract(frame(spark, [row, row])).collect()} == {"one two three four five six seven eight nine ten"}
    assert H.extract(frame(spark, [])).count() == 0


def test_copies_of_a_page_do_not_cover_each_other(spark):
    html = "<div>one two three four five six seven eight nine ten</div>"
    rows = [(i, f"http://a.example/{i}", html) for i in range(3)] + [(9, "http://b.example/", html)]
    assert {r["text"] for r in H.extract(frame(spark, rows), H.ExtractParams(run=5)).collect()} == {"one two three four five six seven eight nine ten"}


def test_the_suffix_array_finds_notices_inside_articles(spark):
    notice = "Sign our weekly letter to get more of this"
    own = [f"Story {i} tells of thing{i} and place{i} and how they met again{i} later on." for i in range(20)]
    rows = [(i, f"http://s.example/{i}", f"<article><p>{own[i]}<p>{notice}" + (f"<p>{own[0]}" if i < 9 else "") + "</article>") for i in range(20)]
    rows += [(100 + i, f"http://few.example/{i}", f"<article><p>{own[i]}<p>{notice}</article>") for i in range(5)]
    rows += [(200 + i, f"http://same.example/{i}", f"<article><p>{own[1]}<p>{own[2]}<p>edition {i}</article>") for i in range(12)]
    rows += rows[:1] * 30
    for p in (H.ExtractParams(), H.ExtractParams(broadcast_rows=0, salts=3)):
        got = {r["page_id"]: r["text"] for r in H.extract(frame(spark, rows), p).collect()}
        assert got[15] == own[15] and got[3] == f"{own[3]}\n{own[0]}"  # a passage in nine of twenty pages is the article's
        assert got[101] == f"{own[1]}\n{notice}"  # too few pages to tell
        assert got[205] == f"{own[1]}\n{own[2]}\nedition 5"  # editions of one article keep their text
    off = {r["page_id"]: r["text"] for r in H.extract(frame(spark, rows), H.ExtractParams(least_pages=10**9)).collect()}
    assert off[15] == f"{own[15]}\n{notice}"


def one(html):
    main, rest = H.split_zones(H.parse(html))
    return main if main is not None else [t for t, is_open in rest if is_open]


@pytest.mark.parametrize(
    "inside",
    [
        "<div class='social-science'>Kept</div>", "<section id='reply'><p>Kept</p></section>", "<p class='byline'>Kept</p>", "<header><h1>T</h1><p>Kept</p></header>",
        "<p class='notice'>Kept</p>", "<div class='share'>Kept, as it has <a href='x'>a</a> link</div>", "<span class='menu-of-the-day'>Kept</span>", "<div class='banner'><div class='reply'>Kept</div></div>",
    ],
)
def test_a_name_alone_drops_no_article_text(inside):
    assert "Kept" in " ".join(one(f"<body><nav>n</nav><article><p>before</p>{inside}<p>after</p></article><footer>f</footer>"))


@pytest.mark.parametrize(
    "inside",
    [
        "<div class='social'><a href='x'>Gone</a> <a href='y'>Gone too</a></div>", "<section id='reply'>Gone <input></section>", "<div class='ad'>Gone</div>", "<div id='comments'><p>Gone</p></div>",
        "<div class='subscribe'><p>Gone</p><form>x</form></div>", "<aside>Gone</aside>", "<div class='cookie-notice'>Gone</div>", "<p hidden>Gone</p>", "<div class='banner'><div class='reply'><a>Gone</a></div></div>",
    ],
)
def test_a_second_sign_or_a_whole_name_drops_it(inside):
    assert one(f"<body><article><p>before</p>{inside}<p>after</p></article>") == ["before", "after"]
    assert one(f"<body><article><p>before</p>{inside}") == ["before"]


def test_the_title_of_main_belongs_to_its_article():
    page = "<main><h1>Title</h1><div class='x'>menu</div><article><p>Text</p></article><h2>More</h2></main><h1>Other</h1>"
    assert one(page) == ["Title", "Text"]


def test_marked_sections_are_comments():
    assert one("<article><![foo[bar]]><p>a</p><![CDATA[x]]><p>b</p><![if IE]>c<![endif]><!x y></article>") == ["a", "b", "c"]


def test_time_grows_with_the_page_only():
    n, start = 40_000, time.perf_counter()
    for page in ("<b>" * n + "</i>" * n, "<i><table>" * (n // 2) + "<b>" * n + "</i>" * n, "<div class='reply'>" * n + "x" + "</div>" * n, "<li>" * n + "</ul>" * n, "<a x" * n, "<p>x" * n, "<h1><p>" * n + "</h2>" * n):
        H.parse(page)
    assert time.perf_counter() - start < 60


def test_a_page_of_ten_megabytes(spark):
    text = "<p>word and word</p>" * 500_000
    (r,) = H.extract(spark.createDataFrame([(1, "http://a.example/1", f"<nav>n</nav><article>{text}</article>")], "page_id long, url string, html string")).collect()
    assert r["n_chars"] == 500_000 * 14 - 1
