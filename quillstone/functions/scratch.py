"""Tables that are written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session on one machine (master ``local``) may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_KEPT: list[str] = []


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables, wherever the shared folder is."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(hadoop).delete(where, True)


def release(spark: SparkSession) -> None:
    """Delete the results that operators wrote in this process; their DataFrames can't be read any more."""
    delete(spark, _KEPT)
    _KEPT.clear()


class Scratch:
    """Written tables of one operator call: lineage is cut, and a lost executor rereads files.

    As a context manager, all tables but those that were :meth:`kept` are deleted at the end.
    """

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.what, self.paths = spark, what, []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/quillstone-{self.what}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def kept(self, df: DataFrame) -> DataFrame:
        """The operator's result, written; it outlives the call, until :func:`release`."""
        out = self.write(df)
        _KEPT.append(self.paths.pop())
        return out

    def drop(self, keep: int = 0) -> None:
        """Delete all tables but the last ``keep``."""
        at = len(self.paths) - keep
        delete(self.spark, self.paths[:at])
        self.paths = self.paths[at:]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()
