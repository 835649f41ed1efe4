"""URL filter: host and path rules, else trust and distrust over the host link graph.

Rules decide the pages they fit.  For all other pages the host decides: personalised PageRank
from the trusted seed hosts follows the links (``trust``), and from the blocked seed hosts it
follows them backwards (``distrust``: who links to a bad host is bad).  A host is blocked if its
distrust is at least ``least`` and more than ``ratio`` times its trust; a host without any
evidence is allowed.

Seeds: hosts that a given table names as blocked or allowed (with pages here or only linked to),
and hosts of whose pages rules block at least ``seed_share`` and allow none (blocked seeds), or allow
at least ``seed_share`` and block none (trusted seeds).  A given verdict comes before the rules' share.

Links are the ``href`` of ``a`` and ``area`` tags, outside comments, scripts and other raw text, with
character references decoded, resolved against the page's url and its ``base``.

Edges are counted per pair of hosts before anything else, self-links are left out, and every step
of the iteration is a written table.  It ends when all that can still arrive anywhere is less than
``tolerance`` of the best score: what is on its way shrinks by ``damping`` a step at least, so that
is reached, after more steps the more seeds share the start.  The ranks are sums (partial on the map side); a host with a
third of all links is only ever a sum.

Edge cases: a null url, or one without ``://``, has the empty host and path, fits no rule and is
allowed; a null html has no links; repeated pages are judged alike and count as pages; an empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


@dataclass(frozen=True)
class TrustParams:
    damping: float = 0.85
    steps: int | None = None  # a bound on the steps, for tests
    tolerance: float = 1e-4
    seed_share: float = 0.9
    ratio: float = 1.0
    least: float = 1e-3


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty if the url has no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The name of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(rule.name)).otherwise(out)
    return out


#: Comments and elements without links are passed over; a tag's quotes count after an equals sign only, and a tag that never
#: ends reaches to the page's end, so no character is read twice.
_LINK = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|xmp|iframe)\b.*?(?:</\1\s*>|\Z)|<(a|area|base)(?=[\s/])((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(>|\Z)""",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"']\S*+)))?+""")


def _href(attributes: str) -> str | None:
    """The value of a tag's first ``href``; None if it has none."""
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() == "href":
            return next((x for x in m.groups()[1:] if x is not None), None)
    return None


def links(url: str | None, page: str | None) -> list[str]:
    """The absolute http(s) urls that a page links to, in order."""
    out, base = [], url or ""
    for m in _LINK.finditer(page or ""):
        if not m[2] or not m[4] or (found := _href(m[3])) is None:
            continue
        href = html.unescape(found).strip()
        try:
            target = urljoin(base, href)
        except ValueError:  # not a url, such as http://[
            continue
        if m[2].lower() == "base":
            base = target
        elif target[:8].lower().startswith(("http://", "https://")):
            out.append(target)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: how many links of pages on ``src`` lead to another host ``dst``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(src, target) for src, url, page in zip(b["src"], b["url"], b["html"], strict=True) for target in links(url, page)]
            yield pd.DataFrame(rows, columns=["src", "target"])

    own = pages.where("html is not null and url is not null").select(host_of(F.col("url")).alias("src"), "url", "html").where("src <> ''")
    found = own.mapInPandas(run, "src string, target string").select("src", host_of(F.col("target")).alias("dst"))
    return found.where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, p: TrustParams, what: str) -> DataFrame:
    """Personalised PageRank ``host, score`` from ``seeds(host, weight)`` along ``edges(src, dst, n)``.

    Weights are shared out to sum to 1; what reaches a host without links ends there.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    shares = materialize(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), f"{what}-shares")
    total = seeds.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first()["w"]
    seeds = materialize(seeds.select("host", (F.col("weight") / F.lit(total or 1.0)).alias("seed")), f"{what}-seeds")
    rank = seeds.select("host", (F.col("seed") * (1 - p.damping)).alias("score"), (F.col("seed") * (1 - p.damping)).alias("new"))
    if shares.isEmpty() or not total:
        return rank.select("host", "score")
    for _ in itertools.count() if p.steps is None else range(p.steps):
        # only what was new in the last step moves on; the scores add up to the whole series
        moved = rank.where("new > 0").join(shares, F.col("host") == F.col("src")).groupBy("dst").agg((p.damping * F.sum(F.col("new") * F.col("share"))).alias("new"))
        moved = moved.select(F.col("dst").alias("host"), F.lit(0.0).alias("score"), "new")
        kept = rank.select("host", "score", F.lit(0.0).alias("new")).union(moved)
        rank = materialize(kept.groupBy("host").agg((F.sum("score") + F.sum("new")).alias("score"), F.sum("new").alias("new")), f"{what}-rank")
        left, best = rank.agg(F.coalesce(F.sum("new"), F.lit(0.0)), F.max("score")).first()
        if left * p.damping / (1 - p.damping) < p.tolerance * best:
            break
    return rank.select("host", "score")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, p: TrustParams = TrustParams(), seeds: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every row of ``pages(page_id, url, html)``.

    ``seeds(host, verdict)``: hosts known to be good (allow) or bad (block); a host given as both is bad.
    """
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.verdict)]) if rules else F.lit(None).cast("map<string,string>")
    judged = judged.withColumn("ruled", F.when(F.col("rule").isNotNull(), verdicts[F.col("rule")]))
    hosts = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "block").alias("bad"), F.count_if(F.col("ruled") == "allow").alias("good"))
    given = pages.sparkSession.createDataFrame([], "host string, verdict string") if seeds is None else seeds
    given = given.where("host is not null and verdict in ('allow', 'block')").groupBy(F.translate("host", _UPPER, _LOWER).alias("host")).agg(F.max("verdict").alias("given"))
    hosts = hosts.join(given, "host", "full").fillna(0, ["n", "bad", "good"])
    blocked = F.when(F.col("given").isNotNull(), F.col("given") == "block").otherwise((F.col("bad") >= p.seed_share * F.col("n")) & (F.col("good") == 0))
    trusted = F.when(F.col("given").isNotNull(), F.col("given") == "allow").otherwise((F.col("good") >= p.seed_share * F.col("n")) & (F.col("bad") == 0))
    hosts = materialize(hosts.select("host", blocked.alias("blocked"), trusted.alias("trusted")), "trust-hosts")
    edges = materialize(host_edges(pages), "trust-edges")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    seed = F.lit(1.0).alias("weight")
    trust = propagate(edges, hosts.where("trusted").select("host", seed), p, "trust").withColumnRenamed("score", "trust")
    distrust = propagate(back, hosts.where("blocked").select("host", seed), p, "distrust").withColumnRenamed("score", "distrust")
    # A share of a seed's own score, so that thresholds do not depend on how many seeds there are.
    scale = {c: d.agg(F.max(c)).first()[0] or 1.0 for c, d in (("trust", trust), ("distrust", distrust))}
    scores = trust.join(distrust, "host", "full").select("host", (F.coalesce("trust", F.lit(0.0)) / scale["trust"]).alias("trust"), (F.coalesce("distrust", F.lit(0.0)) / scale["distrust"]).alias("distrust"))
    out = judged.join(scores, "host", "left").fillna(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") >= p.least) & (F.col("distrust") > p.ratio * F.col("trust"))
    verdict = F.coalesce("ruled", F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
