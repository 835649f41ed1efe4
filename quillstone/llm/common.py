"""Helpers shared by the operators: table access, shared scratch tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: list[tuple[str, str]] = []  # (owner, path)
_OWNER = [""]
_TABLES: dict[str, str] = {}  # names of bucketed scratch tables by path
_KEPT: dict[tuple, object] = {}  # of a Python worker


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read only through Spark's own readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A session on one machine (master ``local``) that doesn't name one gets a temporary folder; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    This cuts lineage and survives lost executors: later stages reread files, never
    recompute.  :func:`release` removes the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstone-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.append((_OWNER[-1], path))
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, what: str, *parts: str) -> DataFrame:
    """Like :func:`materialize`, with rows dealt to buckets by ``key``: joins and groups by it don't move them.

    ``parts``: columns whose values have folders of their own (``column=value``), which can be deleted alone.
    """
    spark = df.sparkSession
    name = f"quillstone_{what.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    writer = df.write.format("parquet").bucketBy(partitions(spark), key).option("path", path)
    (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)
    _SCRATCH.append((_OWNER[-1], path))
    _TABLES[path] = name
    return spark.table(name)


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's.

    It is handed over as Arrow: from Python rows Spark makes an RDD that Python workers of a second kind read,
    and those and their daemon stay beside the workers of the other stages.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows]) for i in range(len(names))], names=names), schema)


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: one thing at a time."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Stages that share Python workers with others call this first: what a worker keeps for an earlier stage goes."""
    if _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables written inside pass at most ``rows`` rows at once to Python; the session's setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """A query's shuffle files go when it ends, not when the driver collects its garbage; the session's setting comes back afterwards."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def current_owner() -> str:
    """The owner of scratch tables that are written now."""
    return _OWNER[-1]


def last_written() -> str:
    """The folder of the scratch table that was written last."""
    return _SCRATCH[-1][1]


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Scratch tables written inside belong to ``owner``."""
    _OWNER.append(owner)
    try:
        yield
    finally:
        _OWNER.pop()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that operators write inside are deleted at the end, and tables in the catalog dropped: results must be written by then."""
    owner = uuid.uuid4().hex
    try:
        with owned(owner):
            yield
    finally:
        release(spark, owner)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table, wherever the shared folder is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession, owner: str) -> None:
    """Delete the owner's scratch tables; all results that read them must be written by now."""
    for path in [p for o, p in _SCRATCH if o == owner]:
        if name := _TABLES.pop(path, None):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)
    _SCRATCH[:] = [x for x in _SCRATCH if x[0] != owner]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, what: str) -> DataFrame:
    """``(node, component)`` of undirected ``edges(a long, b long)``; component: the smallest node.

    Alternating large-star and small-star steps: each step replaces edges by edges to a
    smaller neighbour, so a long chain shortens by about half a step and a hub's edges are
    never expanded into pairs.  Each step's edges are a written table, no lineage grows.
    The hub's neighbours are only aggregated with ``min`` (partial on the map side) and
    joined back, so no group is collected.
    """
    spark = edges.sparkSession
    now = materialize(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), f"{what}-cc")
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: every smaller-or-equal neighbour of u goes to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct(), f"{what}-cc")
        digest = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0)).alias("h"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        digest = tuple(digest)
        if digest == seen:
            break
        seen = digest
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
