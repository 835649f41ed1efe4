"""Collectors that resume: downloads, mirrors, crawls and fallbacks over a table of addresses.

Network access is always a parameter: ``get(url) -> (status, text)`` for pages, ``run(args) -> code`` for commands.
"""

from __future__ import annotations

import importlib
import re
import subprocess
import time
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import attempts
from .html_meta import metadata

Get = Callable[[str], tuple[int, str]]


def download(url: str, path: str, get: Callable[[str], bytes], again: bool = False) -> bool:
    """Fetch a file unless it is there; True if it was fetched.  A partial file never has the final name."""
    target = Path(path)
    if target.exists() and not again:
        return False
    target.parent.mkdir(parents=True, exist_ok=True)
    draft = target.with_name(target.name + ".part")
    draft.write_bytes(get(url))
    draft.replace(target)
    return True


def mirror(source: str, target: str, run: Callable[[list[str]], int] | None = None, tolerated: tuple[int, ...] = (0, 23)) -> int:
    """Copy a remote tree with rsync; code 23 (some files could not be read) is tolerated."""
    args = ["rsync", "-av", "--delete", source, target]
    code = run(args) if run else subprocess.run(args, check=False).returncode
    if code not in tolerated:
        raise RuntimeError(f"{' '.join(args)} ended with code {code}")
    return code


def pending_urls(urls: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """Addresses without a finished row, so that a crawl resumes where it ended."""
    return urls.join(done.select(key).distinct(), key, "left_anti")


def crawl_pages(urls: DataFrame, make_get: Callable[[], Get], pause: float = 0.0) -> DataFrame:
    """``url, status, html`` of every row of ``urls(url)``; one client for each task, ``pause`` seconds between its calls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = make_get()
        for b in batches:
            rows = []
            for at, url in enumerate(b["url"]):
                if at and pause:
                    time.sleep(pause)
                rows.append((url, *get(url)))
            yield pd.DataFrame(rows, columns=["url", "status", "html"])

    return urls.select("url").mapInPandas(run, "url string, status int, html string")


def linked_pages(pages: DataFrame, pattern: str) -> DataFrame:
    """Distinct absolute links of crawled pages that fit a pattern (an issue list's issues, an issue's articles)."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']+)["']"""), F.lit(1))
    root = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    found = pages.select(root.alias("root"), F.explode(links).alias("link"))
    absolute = F.when(F.startswith("link", F.lit("/")), F.concat("root", "link")).otherwise(F.col("link"))
    return found.select(absolute.alias("url")).where(F.rlike("url", F.lit(pattern))).distinct()


def first_metadata(candidates: DataFrame, make_get: Callable[[], Get], wanted: str = "abstract") -> DataFrame:
    """One row for each ``doi`` of ``candidates(doi, urls)``: the first address whose page has the wanted field, else the last page's fields.

    Returns doi, url, title, authors, abstract, keywords, codes, tried.
    """
    fields = ["title", "authors", "abstract", "keywords", "codes"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = make_get()
        for b in batches:
            rows = []
            for doi, urls in zip(b["doi"], b["urls"], strict=True):
                best, tried = ("", dict.fromkeys(fields, "")), 0
                for url in urls if urls is not None else []:
                    tried += 1
                    status, html = get(url)
                    if status == 200:
                        best = url, metadata(html)
                        if best[1][wanted]:
                            break
                rows.append((doi, best[0], *(best[1][f] for f in fields), tried))
            yield pd.DataFrame(rows, columns=["doi", "url", *fields, "tried"])

    return candidates.select("doi", "urls").mapInPandas(run, "doi string, url string, title string, authors string, abstract string, keywords string, codes string, tried int")


_HREF = re.compile(r"""<a\s[^<>]*?href\s*=\s*["']([^"'<>]+)["']""", re.IGNORECASE)
FIELDS = ["title", "authors", "abstract", "keywords", "codes"]


def _client(options: dict[str, str]) -> Get:
    """The client that ``client`` (``module:factory``) makes of the options."""
    module, _, factory = options["client"].partition(":")
    return getattr(importlib.import_module(module), factory)(options)


def _text(get: Get, url: str) -> str:
    status, text = get(url)
    if status != 200:
        raise ConnectionError(f"{url}: status {status}")
    return text


def links_work(options: dict[str, str]) -> attempts.Work:
    """Of a page ``url``: its absolute links that fit ``pattern``, distinct, in order."""
    get, fits = _client(options), re.compile(options["pattern"])

    def work(row: Row) -> dict:
        found = dict.fromkeys(urljoin(row["url"], x) for x in _HREF.findall(_text(get, row["url"])))
        return {"links": [x for x in found if fits.search(x)]}

    return work


def metadata_work(options: dict[str, str]) -> attempts.Work:
    """Of an article's page ``url``: its metadata row."""
    get = _client(options)

    def work(row: Row) -> dict:
        found = metadata(_text(get, row["url"]))
        return {f: found[f] for f in FIELDS}

    return work


def fallback_work(options: dict[str, str]) -> attempts.Work:
    """Of a row's ``urls``: the fields of the first page that has the ``wanted`` one, else of the last page that could be read.

    Addresses that failed are named in the record's errors, whether a later one was found or not.
    """
    get, wanted = _client(options), options.get("wanted", "abstract")

    def work(row: Row) -> dict:
        errors, best = [], None
        for url in row["urls"] or []:
            try:
                found = metadata(_text(get, url))
            except Exception as e:  # the next address may do
                errors.append(f"{type(e).__name__}: {e}")
                continue
            best = {"url": url} | {f: found[f] for f in FIELDS}
            if found[wanted]:
                break
        if best is None:
            raise attempts.WorkError(errors or ["no address"])
        return best | {"_errors": errors}

    return work


def _worked(rows: DataFrame, path: str, key: str, factory: str, how: dict[str, object]) -> DataFrame:
    return attempts.run(rows, path, key, f"quillstone.sources.collect:{factory}", **how)


def crawl_articles(starts: DataFrame, path: str, issue: str, article: str, client: str, **how: object) -> DataFrame:
    """``url, status, attempts, errors`` and the metadata fields of every article that the starts' issues link to.

    ``starts(url)``: pages that list issues; ``issue`` and ``article``: patterns of their addresses; ``client``: ``module:factory``.
    Lists, issues and articles each have a log of attempts below ``path``, so a crawl that was stopped asks again only for what
    is not done; a page's links or row are written when it has been read.  ``how``: see :func:`attempts.run`.
    """
    links = "array<string>"
    todo = starts.select("url")
    for step, pattern in (("lists", issue), ("issues", article)):
        log = _worked(todo, f"{path}/{step}", "url", "links_work", how | {"client": client, "pattern": pattern})
        found = F.from_json("result", f"links {links}")["links"]
        todo = log.where("status = 'done'").select(F.explode(found).alias("url")).distinct()
    log = _worked(todo, f"{path}/articles", "url", "metadata_work", how | {"client": client})
    fields = F.from_json("result", ", ".join(f"{f} string" for f in FIELDS))
    return log.select(F.col("key").alias("url"), "status", "attempts", "errors", fields.alias("r")).select("url", "status", "attempts", "errors", "r.*")


def fallback_metadata(candidates: DataFrame, path: str, client: str, wanted: str = "abstract", **how: object) -> DataFrame:
    """Like :func:`first_metadata`, with a log of attempts: ``doi, status, attempts, errors, url`` and the fields of every row."""
    log = _worked(candidates.select("doi", "urls"), path, "doi", "fallback_work", how | {"client": client, "wanted": wanted})
    fields = F.from_json("result", ", ".join(f"{f} string" for f in ["url", *FIELDS]))
    return log.select(F.col("key").alias("doi"), "status", "attempts", "errors", fields.alias("r")).select("doi", "status", "attempts", "errors", "r.*")
