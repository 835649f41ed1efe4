"""Work on rows that resumes: a log of attempts, appended row by row by a Python data source writer.

The work, mostly a call over the network, is done by the writer's tasks: each row's outcome is a line of the task's own
segment, flushed before the next row begins.  A run that is killed leaves its segments; the next run reads them, takes
what is done as done, and leaves out a line that was cut off.  Committed tasks' segments are renamed, which only says
that they are whole.  A row that is worked on twice, by a task that was tried again, has two records, of which one counts.

A record: ``schema_version``, ``key``, ``status`` (done or failed), ``attempts`` (over all runs), ``errors`` (joined, over all
runs) and ``result`` (JSON).  Records of another schema version are an error, not a guess.  Paths may be anything that
pyarrow's file systems read; a store that shows a file only once it is closed loses the rows of a killed task, which
the next run works on again.
"""

from __future__ import annotations

import importlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .pace import next_slot

SCHEMA_VERSION = 1
LOG = "key string, status string, attempts int, errors string, result string"
Work = Callable[[Row], dict]


class WorkError(Exception):
    """What went wrong on the way, one text for each try inside the work."""

    def __init__(self, errors: list[str]) -> None:
        super().__init__("; ".join(errors))


def named(name: str, options: dict[str, str]) -> Work:
    """The work that ``module:factory`` makes of the options."""
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)(options)


def outcome(work: Work, row: Row, key: str, tries: int, version: int, sleep: Callable[[float], None] = time.sleep, pause: float = 0.0) -> dict:
    """A row's record after at most ``tries`` tries, ``pause`` seconds and then twice as long apart.

    The row's ``attempts`` and ``errors``, if it has them, are those of earlier runs.  A result may name errors
    that it overcame as ``_errors``.
    """
    known = row.asDict()
    attempts, errors, result = known.get("attempts") or 0, [x for x in [known.get("errors")] if x], None
    for n in range(tries):
        attempts += 1
        try:
            result = dict(work(row))
        except Exception as e:  # the record tells what failed; the next rows go on
            errors.append(f"{type(e).__name__}: {e}" if not isinstance(e, WorkError) else str(e))
            if n + 1 < tries and pause:
                sleep(pause * 2**n)
            continue
        errors += result.pop("_errors", [])
        break
    status = "failed" if result is None else "done"
    return {"schema_version": version, "key": known[key], "status": status, "attempts": attempts, "errors": "; ".join(errors), "result": json.dumps(result, sort_keys=True) if result is not None else None}


@dataclass
class Segment(WriterCommitMessage):
    name: str


class AttemptsWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.given = dict(options)

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.given["path"]) if "://" in self.given["path"] or self.given["path"].startswith("file:") else (fs.LocalFileSystem(), self.given["path"])

    def write(self, iterator: Iterator[Row]) -> Segment:
        o = self.given
        work, store = named(o["work"], o), self._place()
        store[0].create_dir(store[1], recursive=True)
        name = uuid.uuid4().hex
        seconds, lanes, lane = float(o.get("seconds", 0)), int(o.get("lanes", 1)), TaskContext.get().partitionId() if TaskContext.get() else 0
        begun = float(o.get("begun", 0))
        with store[0].open_output_stream(f"{store[1]}/draft-{name}.jsonl") as out:
            for row in iterator:
                if seconds:
                    time.sleep(max(0.0, next_slot(time.time(), begun, lane % lanes, lanes, seconds) - time.time()))
                record = outcome(work, row, o["key"], int(o.get("tries", 1)), int(o.get("version", SCHEMA_VERSION)), pause=float(o.get("pause", 0)))
                out.write(json.dumps(record).encode() + b"\n")
                out.flush()
        return Segment(name)

    def commit(self, messages: list[Segment | None]) -> None:
        store, path = self._place()
        for m in messages:
            if m is not None:
                store.move(f"{path}/draft-{m.name}.jsonl", f"{path}/part-{m.name}.jsonl")

    def abort(self, messages: list[Segment | None]) -> None:
        """Whole tasks' segments are kept like committed ones; the others stay drafts.  Both count when the log is read."""
        self.commit(messages)


class AttemptsSource(DataSource):
    """``df.write.format("attempts")`` with options ``path``, ``key`` (a column), ``work`` (``module:factory``), and as may be
    ``tries``, ``pause``, ``version``; ``seconds``, ``lanes`` and ``begun`` for one pace over all tasks."""

    @classmethod
    def name(cls) -> str:
        return "attempts"

    def schema(self) -> str:
        return LOG

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a log of attempts is only appended to")
        return AttemptsWriter(self.options)


def read_log(spark: SparkSession, path: str, version: int = SCHEMA_VERSION) -> DataFrame:
    """The log's last record of each key: ``key, status, attempts, errors, result``; no rows if there is no log yet.

    A done record comes before failed ones, then the one of more attempts.  A draft's line that was cut off is no
    record; any other line that is none, and a record of another version, is an error that is raised when it is read.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], LOG)
    lines = spark.read.option("pathGlobFilter", "*.jsonl").text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"))
    record = F.from_json("line", f"schema_version int, {LOG}")
    whole = F.try_parse_json("line").isNotNull()
    lines = lines.where(whole | ~F.startswith("file", F.lit("draft-")))
    read = lines.select("file", F.when(whole, record).otherwise(F.raise_error(F.concat(F.lit("bad record in "), "file"))).alias("r")).select("file", "r.*")
    other = F.concat(F.lit(f"the log has schema version {version} here, but a record of version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("none")))
    checked = read.withColumn("status", F.when(F.col("schema_version").eqNullSafe(version), F.col("status")).otherwise(F.raise_error(other)))
    names = ["status", "attempts", "errors", "result"]
    last = F.max_by(F.struct(*names), F.struct(F.col("status") == "done", "attempts", "file"))
    return checked.groupBy("key").agg(last.alias("r")).select("key", *[F.col(f"r.{n}").alias(n) for n in names])


def to_do(rows: DataFrame, log: DataFrame, key: str, most: int = 3, again: bool = True) -> DataFrame:
    """Rows of ``rows`` without a done record, with their ``attempts`` and ``errors`` so far.

    Failed ones are tried again, unless ``again`` is false, until they have ``most`` attempts.
    """
    tried = log.select(F.col("key").alias("_key"), "status", "attempts", "errors")
    met = rows.join(tried, F.col(key).cast("string") == F.col("_key"), "left")
    failed = (F.col("status") == "failed") & F.lit(again) & (F.col("attempts") < most)
    return met.where(F.col("status").isNull() | failed).drop("_key", "status")


def run(rows: DataFrame, path: str, key: str, work: str, tries: int = 1, most: int = 3, again: bool = True, version: int = SCHEMA_VERSION, lanes: int = 0, **options: str) -> DataFrame:
    """Work on what is not done yet, then the log's last records of all keys.

    ``work``: ``module:factory``; the factory takes the options.  Rows are one for each key; ``lanes`` (with ``seconds``): as
    many tasks, which keep one pace.
    """
    spark = rows.sparkSession
    spark.dataSource.register(AttemptsSource)
    left = to_do(rows.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn(key, F.col(key).cast("string")), read_log(spark, path, version), key, most, again)
    left = left.repartition(lanes) if lanes else left
    given = {"path": path, "key": key, "work": work, "tries": tries, "version": version, "lanes": max(1, lanes), "begun": time.time()} | options
    left.write.format("attempts").mode("append").options(**{k: str(v) for k, v in given.items()}).save()
    return read_log(spark, path, version)
