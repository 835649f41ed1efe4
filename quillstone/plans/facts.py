"""Fact tables of the stand-in domain: orders are papers, large line items their authors, part types fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import spread

PERIODS = {"early": (1996, 1998), "late": (1999, 2001)}
LOOK_BACK = 3
#: Line items that a task of a fact table's joins holds, about.
TASK_LINES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``paper, y`` of all papers."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper"), F.year("o_orderdate").alias("y"))


def parts(spark: SparkSession, sf_dir: str) -> int:
    """How many partitions give each about ``TASK_LINES`` line items; 0 for tables that are no larger than that."""
    lines = table(spark, sf_dir, "lineitem").count()
    return 0 if lines <= TASK_LINES else max(-(-lines // TASK_LINES), spark.sparkContext.defaultParallelism)


def author_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``paper, author, y``: distinct; the filter reaches the scan."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 40").select(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("author"))
    return spread(lines, parts(spark, sf_dir), "paper").distinct().join(papers(spark, sf_dir), "paper")


def paper_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``paper, field``: distinct part types of all lines of an order."""
    types = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("field"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), "l_partkey")
    n = parts(spark, sf_dir)
    return spread(spread(lines, n, "l_partkey").join(types, "l_partkey").select("paper", "field"), n, "paper").distinct()


def field_author_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``field, paper, author, y``."""
    return author_papers(spark, sf_dir).join(paper_fields(spark, sf_dir), "paper")


def field_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``field, paper, y`` of papers that have an author."""
    return field_author_papers(spark, sf_dir).select("field", "paper", "y").distinct()


AP = """papers AS (SELECT o_orderkey AS paper, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders),
ap AS (SELECT DISTINCT l_orderkey AS paper, l_partkey AS author, y FROM lineitem JOIN papers ON l_orderkey = paper WHERE l_quantity >= 40)"""
FAP = (
    AP
    + """,
pf AS (SELECT DISTINCT l_orderkey AS paper, p_type AS field FROM lineitem JOIN part ON l_partkey = p_partkey),
fap AS (SELECT field, ap.paper, author, y FROM ap JOIN pf ON pf.paper = ap.paper)"""
)
