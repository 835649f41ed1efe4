"""REST collectors as a Python data source: one partition for each journal and year, cursor paging, retries.

The transport is a parameter: a callable ``(url, params) -> (status, headers, json)``, or with the call's own headers as a
third argument where a token is sent, named to the source as ``module:factory`` (a factory takes the options), so that
executors import it.  ``fixtures`` names a folder of answers instead, because engines are tested without a network.

As a batch, each journal and year is a partition; as a stream, the place in the chain of pages is the offset, so a
collection that was stopped goes on at the page where it was.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions.text import DOI_VARIANTS, doi_key
from .pace import in_lane

Transport = Callable[..., tuple[int, dict[str, str], dict]]


def wait_seconds(attempt: int, headers: dict[str, str], most: float = 300.0) -> float:
    """Retry-After where it is given, else twice as long each time, at most ``most``."""
    given = headers.get("Retry-After", "")
    return min(most, float(given)) if given.replace(".", "", 1).isdigit() else min(most, 2.0**attempt)


def fetch(transport: Transport, url: str, params: dict[str, str], attempts: int = 8, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One page; 429 and 5xx are tried again."""
    for attempt in range(attempts):
        status, headers, body = transport(url, params)
        if status == 200:
            return body
        if status != 429 and status < 500:
            raise ValueError(f"{url}: status {status}")
        sleep(wait_seconds(attempt, headers))
    raise TimeoutError(f"{url}: no answer after {attempts} attempts")


def pages(transport: Transport, url: str, params: dict[str, str], **how: object) -> Iterator[dict]:
    """Records of all pages, by the cursor that each page names."""
    cursor = "*"
    while cursor:
        body = fetch(transport, url, params | {"cursor": cursor}, **how)
        yield from body.get("results", [])
        cursor = (body.get("meta") or {}).get("next_cursor")


def fixture_transport(folder: str) -> Transport:
    """Pages from files ``<source>-<year>-<n>.json``; the cursor is the page number."""

    def get(url: str, params: dict[str, str]) -> tuple[int, dict[str, str], dict]:
        n = 0 if params["cursor"] == "*" else int(params["cursor"])
        own = Path(folder) / f"{url}-{params['year']}-{n}.json"
        if not own.exists():
            return 200, {}, {"results": [], "meta": {}}
        body = json.loads(own.read_text())
        more = (Path(folder) / f"{url}-{params['year']}-{n + 1}.json").exists()
        return 200, {}, {"results": body, "meta": {"next_cursor": str(n + 1) if more else None}}

    return get


class WorksPartition(InputPartition):
    """Journals' years that one task collects, and its lane in the pace of all."""

    def __init__(self, units: list[tuple[str, int]], lane: int, lanes: int) -> None:
        super().__init__(lane)
        self.units, self.lane, self.lanes = units, lane, lanes


def named_transport(options: dict[str, str]) -> Transport:
    """The transport that the options name, or the fixture folder's."""
    if name := options.get("transport"):
        module, _, factory = name.partition(":")
        return getattr(importlib.import_module(module), factory)(options)
    return fixture_transport(options["fixtures"])


def paced(transport: Transport, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Transport:
    """At least ``seconds`` between the starts of two calls."""
    last = [float("-inf")]

    def call(url: str, params: dict[str, str], *headers: dict[str, str]) -> tuple[int, dict[str, str], dict]:
        wait = last[0] + seconds - clock()
        if wait > 0:
            sleep(wait)
        last[0] = clock()
        return transport(url, params, *headers)

    return call


def cached(transport: Transport, folder: str) -> Transport:
    """Good answers are kept as files by the hash of the call, without its headers, and never asked for again."""

    def call(url: str, params: dict[str, str], *headers: dict[str, str]) -> tuple[int, dict[str, str], dict]:
        name = hashlib.sha256(json.dumps([url, params], sort_keys=True).encode()).hexdigest()
        path = Path(folder) / f"{name}.json"
        if path.exists():
            return 200, {}, json.loads(path.read_text())
        status, got, body = transport(url, params, *headers)
        if status == 200:
            path.parent.mkdir(parents=True, exist_ok=True)
            draft = path.with_suffix(f".{uuid.uuid4().hex}")
            draft.write_text(json.dumps(body))
            draft.replace(path)
        return status, got, body

    return call


def with_token(transport: Transport, token: str) -> Transport:
    """Every call carries a bearer token in its headers, never in its parameters."""
    return lambda url, params, *headers: transport(url, params, (headers[0] if headers else {}) | {"Authorization": f"Bearer {token}"})


def first_by_doi(df: DataFrame, doi: Column, order: list[Column]) -> DataFrame:
    """The first record of each normalized DOI within and across years; records without one all stay."""
    key = doi_key(doi, **DOI_VARIANTS["collected"])
    keyed = df.withColumn("_k", key)
    place = F.row_number().over(Window.partitionBy("_k").orderBy(*order))
    first = keyed.where("_k <> ''").withColumn("_r", place).where("_r = 1").drop("_r", "_k")
    return first.unionByName(keyed.where("_k = ''").drop("_k"))


def units(options: dict[str, str]) -> list[tuple[str, int]]:
    return [(s, y) for s in options["sources"].split(",") for y in range(int(options["from"]), int(options["to"]) + 1)]


def _row(source: str, year: int, record: dict) -> tuple:
    return source, year, str(record.get("id", "")), json.dumps(record, sort_keys=True)


class WorksReader(DataSourceReader):
    """A partition for each journal and year; with ``seconds``, ``lanes`` partitions that together begin one call in so many seconds."""

    def __init__(self, options: dict[str, str]) -> None:
        self.given = dict(options)
        self.units = units(options)
        self.seconds, self.begun = float(options.get("seconds", 0)), time.time()

    def partitions(self) -> list[InputPartition]:
        lanes = min(int(self.given.get("lanes", 4)) if self.seconds else len(self.units), len(self.units))
        return [WorksPartition(self.units[i::lanes], i, lanes) for i in range(lanes)]

    def read(self, partition: WorksPartition) -> Iterator[tuple]:
        transport = named_transport(self.given)
        if self.seconds:
            transport = in_lane(transport, self.begun, partition.lane, partition.lanes, self.seconds)
        for source, year in partition.units:
            for record in pages(transport, source, {"year": str(year)}):
                yield _row(source, year, record)


class WorksStream(SimpleDataSourceStreamReader):
    """Pages in the order of journals and years; the offset is the unit's number and the cursor of its next page.

    A batch is at most ``pages`` pages.  Pages are asked for one after the other, as cursors demand, in one process, which
    keeps one pace over all units; records of one batch are all that passes through it.  A stream that starts again with
    its checkpoint goes on at the offset; only a batch that was not committed is asked for again.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.units = units(options)
        self.most = int(options.get("pages", 10))
        self.transport = named_transport(options)
        if seconds := float(options.get("seconds", 0)):
            self.transport = paced(self.transport, seconds)

    def initialOffset(self) -> dict:
        return {"unit": 0, "cursor": "*"}

    def _page(self, at: dict) -> tuple[list[tuple], dict]:
        source, year = self.units[at["unit"]]
        body = fetch(self.transport, source, {"year": str(year), "cursor": at["cursor"]})
        after = (body.get("meta") or {}).get("next_cursor")
        return [_row(source, year, r) for r in body.get("results", [])], {"unit": at["unit"], "cursor": after} if after else {"unit": at["unit"] + 1, "cursor": "*"}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at, n = [], start, 0
        while at["unit"] < len(self.units) and n < self.most:
            more, at = self._page(at)
            rows += more
            n += 1
        return iter(rows), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start
        while at != end:
            more, at = self._page(at)
            yield from more


class WorksSource(DataSource):
    """``spark.dataSource.register(WorksSource)``, then ``spark.read`` or ``spark.readStream`` with ``format("works")`` and options
    ``transport`` (``module:factory``) or ``fixtures`` (shared folder), ``sources`` (by comma), ``from`` and ``to`` (years);
    as may be ``seconds`` between calls, ``lanes`` (of a batch), ``pages`` (of a stream's batch)."""

    @classmethod
    def name(cls) -> str:
        return "works"

    def schema(self) -> str:
        return "source string, year int, id string, record string"

    def reader(self, schema: object) -> DataSourceReader:
        return WorksReader(self.options)

    def simpleStreamReader(self, schema: object) -> SimpleDataSourceStreamReader:
        return WorksStream(self.options)
