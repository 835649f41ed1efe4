"""Main text of web pages, with boilerplate found by a host suffix array.

Every page is parsed to blocks (the text between block-level tags) in three zones:

* ``main``: inside the article and in the title of the main element around it (else inside the main
  element, else inside a container named as content), but not in a menu, footer, sidebar, notice, advert,
  form or comment within it.  The article's own header is its text.  Within an article a class name alone
  drops nothing, unless the whole name stands for what is never text (``ad``, ``comments``); other names
  that speak against a block need a second sign, controls or mostly links;
* ``out``: inside such parts, or in scripts, styles and other invisible elements;
* ``open``: everything else.

A page with a main zone gives its main blocks, but for what the suffix array of its host shows to
be the site's own: a block that stands in more than ``share`` of the host's distinct pages, and in
``least_pages`` at least, is a notice, not the article, however it is marked up.  (If such blocks
hold most of a page's main text, the page is one of many editions of one article and keeps all.)
A page without a main zone gives its open blocks minus what the suffix array covers.

Host suffix array.  The token streams of a host's pages are concatenated, with page ends as
barriers.  Outside main zones every token starts a suffix; a token is boilerplate if it lies in a
substring of at least ``run`` tokens that also occurs on another page of the host.  Which tokens
these are depends only on suffixes that agree in their first ``run`` tokens, so the suffixes are
sorted by that prefix and no further: each suffix goes to the shard of (host, prefix), and a prefix
that two distinct pages have marks its tokens: the union of the longest repeats.  Inside main zones the array
is sparse: only block starts are suffixes, and they are sorted by the whole block.  Per prefix only
a count and the least and greatest page are kept (summed on the map side), so a host with a
third of all pages, or a notice on all of them, is never one task.  What is found meets the pages
again through a broadcast of counted size, or beyond it through a join that is salted by page.
Covered tokens are removed; the unique runs stay, block by block.

Why tags come first: a menu, advert or footer that only one page of a host shows repeats nowhere,
so repeats alone would leave it in; markup decides what is outside the article, and repeats decide
what markup leaves open.

Text: character references are decoded, white space inside a block is one space, blocks are
trimmed, empty ones left out, and joined by one line feed in page order.

Edge cases: null or empty html gives the empty text; unclosed and stray tags are tolerated; pages
of a host with equal html are one page for the suffix array and one row each in the result; a
null url belongs to the empty host; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markup import TolerantParser
from .common import materialize
from .url_trust import host_of

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INVISIBLE = frozenset("script style noscript template iframe svg canvas math object audio video map head title select option datalist button textarea".split())
_OUT = frozenset("nav header footer aside form dialog menu fieldset search".split())
_BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table
    tbody td tfoot th thead title tr ul""".split()
)
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of class and id names that mark what is not the article, wherever a page is not marked as one.
_OUT_NAMES = frozenset(
    """ad ads adv advert advertisement advertisements adverts adsense advertising banner breadcrumb breadcrumbs byline
    comment comments consent cookie cookies copyright disclaimer discussion disqus footer gdpr header login masthead menu
    modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promos promoted
    promotion reactions recommended related replies reply respond rss share sharing sidebar signup skip social sponsor
    sponsored sponsors subscribe subscription toc toolbar tooltip topbar trending widget widgets""".split()
)
#: Whole class and id names that also decide inside an article: what they name is never its text.
_NEVER_TEXT = frozenset(
    """ad ads adv advert advertisement advertisements adverts adsense advertising breadcrumb breadcrumbs comments comment-list
    comment-section comments-section cookie-banner cookie-consent cookie-notice cookies-notice disqus disqus-thread gdpr menu nav navbar navigation newsletter
    newsletter-signup pagination popup related related-articles related-posts related-links share-bar share-buttons share-links sharing
    sidebar social-links social-share sponsored""".split()
)
#: Words of class and id names that mark the article, where no article or main element does.
_MAIN_NAMES = frozenset("article content entry maincontent post story".split())
_CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
_P_ENDS = _BLOCK - frozenset(["body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "dd", "dt", "li", "title"])
_SCOPE = frozenset("table ul ol dl article main section div body html td th".split())
#: An end tag of no container closes nothing beyond these.
_WALLS = frozenset("article main td th table".split())
_CONTROLS = frozenset("form input button select textarea".split())
_NAME = re.compile(r"[a-z]+|[0-9]+")


@dataclass(frozen=True)
class ExtractParams:
    run: int = 8
    share: float = 0.5
    least_pages: int = 8
    broadcast_rows: int = 500_000
    salts: int = 16


@dataclass
class _Open:
    tag: str
    out: bool
    main: int  # 3 in an article, 2 in a main element, 1 in a container named as content, else 0
    doubted: int = -1  # of a block in an article whose name speaks against it: the number of blocks before it
    chars: int = 0  # of the doubted block, and how many of them are in links
    linked: int = 0
    controls: bool = False


@dataclass
class Page:
    """Blocks in page order: (text, zone rank or -1 for out)."""

    blocks: list[tuple[str, int]] = field(default_factory=list)


class _Places:
    """Where elements of some tags stand on the stack, the last one first at hand."""

    def __init__(self) -> None:
        self.by_tag: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.walls: list[int] = []

    def push(self, tag: str, at: int) -> None:
        self.by_tag.setdefault(tag, []).append(at)
        if tag in _SCOPE:
            self.scopes.append(at)
        if tag in _WALLS:
            self.walls.append(at)

    def pop(self, tag: str) -> None:
        self.by_tag[tag].pop()
        if tag in _SCOPE:
            self.scopes.pop()
        if tag in _WALLS:
            self.walls.pop()

    def last(self, tag: str) -> int:
        found = self.by_tag.get(tag)
        return found[-1] if found else 0


class _Parser(TolerantParser):
    """Blocks and zones.  Each tag and text costs a bounded number of steps, whatever is open: no open element is searched for."""

    def __init__(self) -> None:
        super().__init__()
        self.page = Page()
        self.stack: list[_Open] = [_Open("", False, 0)]
        self.places = _Places()
        self.doubts: list[int] = []  # places of open doubted elements
        self.text: list[str] = []

    def flush(self) -> None:
        if self.text:
            block = " ".join("".join(self.text).split())
            self.text = []
            top = self.stack[-1]
            if block:
                rank = 3 if top.main == 2 and self.places.last("h1") else top.main  # a main element's title belongs to its article
                self.page.blocks.append((block, -1 if top.out else rank))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK:
            self.flush()
        if tag in _CONTROLS and self.doubts:
            self.stack[self.doubts[-1]].controls = True
        if tag in _VOID:
            if tag == "br":
                self.text.append(" ")
            return
        if tag in _P_ENDS:
            self._close(frozenset(["p"]))
        if tag in _CLOSED_BY:
            self._close(_CLOSED_BY[tag])
        up = self.stack[-1]
        names = {k: v or "" for k, v in attrs}
        whole = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", f"{names.get('class', '')} {names.get('id', '')}").lower().replace("_", "-").split() if tag not in ("html", "body") else []
        words = {w for name in whole for w in _NAME.findall(name)}
        role = names.get("role", "").lower()
        kind = 0
        if tag == "article":
            kind = 3
        elif tag == "main" or role == "main" or "articlebody" in names.get("itemprop", "").lower():
            kind = 2
        elif tag in ("div", "section", "td") and words & _MAIN_NAMES and not words & _OUT_NAMES:
            kind = 1
        hidden = "hidden" in names or names.get("aria-hidden", "").lower() == "true" or "display:none" in names.get("style", "").replace(" ", "").lower()
        inside = up.main > 0 or tag in ("main", "article")
        named = bool(words & _OUT_NAMES)
        own_header = tag == "header" and up.main > 0  # an article's header is its own
        out = up.out or tag in _INVISIBLE or (tag in _OUT and not own_header) or role in _OUT_ROLES or hidden or (named and not inside) or not _NEVER_TEXT.isdisjoint(whole)
        doubted = named and inside and not out and tag in _BLOCK and tag not in ("main", "header")
        if out is not up.out or kind > up.main or doubted:
            self.flush()
        self.places.push(tag, len(self.stack))
        if doubted:
            self.doubts.append(len(self.stack))
        self.stack.append(_Open(tag, out, max(kind, up.main), len(self.page.blocks) if doubted else -1))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close an HTML element

    def _cut(self, at: int) -> None:
        """Close the element at a place and all within it."""
        while len(self.stack) > at:
            top, up = self.stack[-1], self.stack[-2]
            if top.out is not up.out or top.main != up.main or top.doubted >= 0 or top.tag == "h1":
                self.flush()
            self.stack.pop()
            self.places.pop(top.tag)
            if top.doubted >= 0:
                self.doubts.pop()
                if top.controls or 2 * top.linked > top.chars:  # the second sign: controls, or mostly links
                    blocks = self.page.blocks
                    blocks[top.doubted :] = [(t, -1) for t, _ in blocks[top.doubted :]]
                elif self.doubts:
                    outer = self.stack[self.doubts[-1]]
                    outer.chars, outer.linked = outer.chars + top.chars, outer.linked + top.linked

    def _close(self, tags: frozenset[str]) -> None:
        """Close the nearest open element of ``tags``, unless a container lies between."""
        at = max(map(self.places.last, tags))
        if at and (not self.places.scopes or at >= self.places.scopes[-1]):
            self.flush()
            self._cut(at)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self.flush()
        at = self.places.last(tag)
        if at and (tag in _SCOPE or not self.places.walls or at >= self.places.walls[-1]):
            self._cut(at)

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.doubts:
            inner, size = self.stack[self.doubts[-1]], len("".join(data.split()))
            inner.chars += size
            inner.linked += size if self.places.last("a") > self.doubts[-1] else 0


def parse(html: str) -> Page:
    """The blocks of a page."""
    parser = _Parser()
    parser.read(html)
    parser.flush()
    parser._cut(1)
    return parser.page


def split_zones(page: Page) -> tuple[list[str] | None, list[tuple[str, bool]]]:
    """``(main blocks or None, the rest as (text, is it open))``."""
    rank = max((r for _, r in page.blocks), default=0)
    if rank > 0:
        return [t for t, r in page.blocks if r == rank], [(t, False) for t, r in page.blocks if r != rank]
    return None, [(t, r == 0) for t, r in page.blocks]


def suffix_prefixes(tokens: list[str], run: int) -> np.ndarray:
    """Signed hashes of the first ``run`` tokens of every suffix that has so many."""
    if len(tokens) < run:
        return np.empty(0, dtype=np.int64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in tokens), dtype=np.uint64, count=len(tokens))
    out = np.zeros(len(tokens) - run + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(run):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - run + 1 + k]
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def unique_runs(blocks: list[tuple[str, bool]], covered: set[int], run: int) -> list[str]:
    """The open blocks without the tokens that the marked suffixes (by their place) cover."""
    out, at = [], 0
    gone: set[int] = {i + k for i in covered for k in range(run)}
    for text, is_open in blocks:
        tokens = text.split()
        kept = [t for i, t in enumerate(tokens, at) if i not in gone]
        at += len(tokens)
        if is_open and kept:
            out.append(" ".join(kept))
    return out


def block_hash(block: str) -> int:
    """Signed hash of a block's tokens, the key of the suffix that starts with it."""
    h = xxhash.xxh3_64_intdigest(block.encode("utf-8", "surrogatepass"))
    return h - (h >> 63 << 64)


def _met(pages: DataFrame, found: DataFrame, keys: list[str], p: ExtractParams) -> DataFrame:
    """``pages`` with ``found`` by ``keys``: broadcast if it has few rows, as counted, else salted by page."""
    if found.count() <= p.broadcast_rows:
        return pages.join(F.broadcast(found), keys)
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
    return pages.withColumn("salt", F.pmod(F.col("page"), F.lit(p.salts)).cast("int")).join(salted, [*keys, "salt"]).drop("salt")


def _notices(parsed: DataFrame, p: ExtractParams) -> DataFrame:
    """``page, notices``: hashes of main blocks that are the host's own, by page."""
    heads = parsed.where("main is not null").select(F.xxhash64("host").alias("site"), "page", F.explode(F.array_distinct("heads")).alias("head"))
    found = heads.groupBy("site", "head").agg(F.count("*").alias("n"), F.min("page").alias("a"), F.max("page").alias("b"))
    found = materialize(found.where((F.col("n") >= p.least_pages) & (F.col("a") != F.col("b"))).select("site", "head"), "html-heads")
    # repeated pages count once, so what passed is counted again over distinct pages
    met = materialize(_met(heads, found, ["site", "head"], p).distinct(), "html-met")
    pages = parsed.select(F.xxhash64("host").alias("site"), "page").join(found.select("site").distinct(), "site", "left_semi").distinct().groupBy("site").agg(F.count("*").alias("pages"))
    shown = met.groupBy("site", "head").agg(F.count("*").alias("n")).join(pages, "site")
    shown = shown.where((F.col("n") >= p.least_pages) & (F.col("n") > p.share * F.col("pages"))).select("site", "head")
    return _met(met, shown, ["site", "head"], p).groupBy("page").agg(F.collect_set("head").alias("notices"))


def extract(pages: DataFrame, p: ExtractParams = ExtractParams()) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("page", F.xxhash64("host", "html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            mains, heads, rests, opens, marks = [], [], [], [], []
            for html in b["html"]:
                main, rest = split_zones(parse(html))
                mains.append(main)
                heads.append(None if main is None else [block_hash(x) for x in main])
                needed = main is None
                rests.append([t for t, _ in rest] if needed else None)
                opens.append([o for _, o in rest] if needed else None)
                marks.append(suffix_prefixes([t for text, _ in rest for t in text.split()], p.run))
            yield b[["page_id", "url", "host", "page"]].assign(main=mains, heads=heads, rest=rests, open=opens, marks=marks)

    kind = "page_id long, url string, host string, page long, main array<string>, heads array<long>, rest array<string>, open array<boolean>, marks array<long>"
    parsed = materialize(base.mapInPandas(run, kind), "html-parsed")
    notices = materialize(_notices(parsed, p), "html-notices")

    # Pages without a main zone: suffixes of the hosts that have such pages.
    unsure = parsed.where("main is null")
    hosts = unsure.select("host").distinct()
    suffixes = parsed.join(F.broadcast(hosts) if hosts.count() <= p.broadcast_rows else hosts, "host", "left_semi").select("host", "page", F.explode("marks").alias("prefix"))
    repeated = suffixes.groupBy("host", "prefix").agg(F.min("page").alias("a"), F.max("page").alias("b")).where("a <> b").select("host", "prefix")
    repeated = materialize(repeated, "html-repeated")
    places = _met(unsure.select("host", "page", F.posexplode("marks").alias("at", "prefix")), repeated, ["host", "prefix"], p).select("page", "at").distinct()
    covered = places.groupBy("page").agg(F.collect_list("at").alias("covered"))

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = ["\n".join(unique_runs(list(zip(rest, is_open, strict=True)), set() if c is None else {int(x) for x in c}, p.run)) for rest, is_open, c in zip(b["rest"], b["open"], b["covered"], strict=True)]
            yield b[["page_id", "url"]].assign(text=texts)

    other = unsure.join(covered, "page", "left").select("page_id", "url", "rest", "open", "covered").mapInPandas(rebuild, "page_id long, url string, text string")
    whole = parsed.where("main is not null").select("page_id", "url", "page", "main", "heads")
    whole = whole.join(F.broadcast(notices) if notices.count() <= p.broadcast_rows else notices, "page", "left")
    kept = F.transform(F.filter(F.arrays_zip("main", "heads"), lambda x: ~F.array_contains("notices", x["heads"])), lambda x: x["main"])
    text, left = F.array_join("main", "\n"), F.array_join(kept, "\n")
    whole = whole.select("page_id", "url", F.when(F.col("notices").isNull() | (2 * F.length(left) < F.length(text)), text).otherwise(left).alias("text"))
    return whole.union(other).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
