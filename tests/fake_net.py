"""A network of files for workers: each call leaves a file, so that tests see what was asked for and when."""

import json
import os
import time
import uuid
from pathlib import Path


def _seen(options, url):
    folder = Path(options["calls"])
    folder.mkdir(parents=True, exist_ok=True)
    (folder / uuid.uuid4().hex).write_text(json.dumps([url, time.time()]))


def calls(folder):
    return sorted((json.loads(p.read_text()) for p in Path(folder).iterdir()), key=lambda x: x[1])


def client(options):
    """Pages of a JSON file; 404 for others; a page of the text ``500`` fails until the file ``mended`` is there."""
    pages = json.loads(Path(options["pages"]).read_text())

    def get(url):
        _seen(options, url)
        if pages.get(url) == "500" and not Path(options["pages"] + ".mended").exists():
            return 500, ""
        return (200, pages[url]) if url in pages else (404, "")

    return get


def squares(options):
    """Work that kills its process at row ``dies_at`` unless the file ``calls``/../alive is there."""

    def work(row):
        n = int(row["k"])
        if str(n) == options.get("dies_at") and not (Path(options["calls"]).parent / "alive").exists():
            os._exit(9)
        _seen(options, str(n))
        if n < 0:
            raise ValueError(f"below zero: {n}")
        return {"square": n * n}

    return work


def transport(options):
    """Three pages of two records for each source and year; with ``fails``, every call there fails while that file is there."""

    def get(url, params, *headers):
        _seen(options, f"{url}-{params['year']}-{params['cursor']}")
        if options.get("fails") and Path(options["fails"]).exists():
            return 404, {}, {}
        n = 0 if params["cursor"] == "*" else int(params["cursor"])
        return 200, {}, {"results": [{"id": f"{url}-{params['year']}-{n}-{i}"} for i in range(2)], "meta": {"next_cursor": str(n + 1) if n < 2 else None}}

    return get
