"""File sources and sinks: CSV, TSV, JSON lines, text; all values are strings, blanks stay blank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """All-string CSV with a header; quotes are doubled, cells may span lines; missing is blank."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').option("nullValue", "\x00").option("emptyValue", "")
    return (reader.schema(schema) if schema else reader).csv(path).na.fill("")


def read_csv_with_nulls(spark: SparkSession, path: str) -> DataFrame:
    """The same, but the usual missing-value words are blank too."""
    df = read_csv(spark, path)
    words = ["NA", "N/A", "NULL", "null", "NaN", "nan", "None", "n/a", "#N/A", "<NA>"]
    return df.select(*[F.when(F.col(c).isin(*words), "").otherwise(F.col(c)).alias(c) for c in df.columns])


def read_tsv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Tab-separated, no quoting."""
    return spark.read.option("header", True).option("sep", "\t").option("quote", "").option("encoding", encoding).csv(path).na.fill("")


def read_delimited(spark: SparkSession, path: str, columns: list[str], sep: str, quote: str) -> DataFrame:
    """Delimited text without a header, its columns given by name; gzip is read as it is."""
    schema = StructType.fromDDL(", ".join(f"`{c}` STRING" for c in columns))
    return spark.read.option("sep", sep).option("quote", quote).schema(schema).csv(path).na.fill("")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """``text`` of every line, with its file, the file's block that a task read it from, and ascending places in the block."""
    names = {"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "place": F.monotonically_increasing_id()}
    return spark.read.text(path).select(F.col("value").alias("text"), *[c.alias(n) for n, c in names.items()])


def _lines_before(blocks: DataFrame) -> DataFrame:
    """Of ``blocks(file, block, lines)``: how many lines of the file stand before each block; a file has few blocks."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("before", F.coalesce(F.sum("lines").over(earlier), F.lit(0)))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, text`` of text files of any size, which are read in splits; ``line`` counts from 1.

    Blocks' line counts are one small table; their sums, file by file, are what each block's lines start from.
    """
    lines = _blocks(spark, path)
    starts = _lines_before(lines.groupBy("file", "block").agg(F.count("*").alias("lines"), F.min("place").alias("first")))
    return lines.join(starts.select("file", "block", "first", "before"), ["file", "block"]).select("file", (F.col("before") + F.col("place") - F.col("first") + 1).alias("line"), "text")


def bad_json_line(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """File and number of a line that is no JSON, the first of its file; None if all are.

    One aggregating pass: each block gives its number of lines and its first bad one, and no line is moved.
    """
    bad = (F.trim("text") != "") & F.try_parse_json("text").isNull()
    blocks = _blocks(spark, path).groupBy("file", "block").agg(F.count("*").alias("lines"), F.min("place").alias("first"), F.min(F.when(bad, F.col("place"))).alias("bad"))
    found = _lines_before(blocks).where("bad IS NOT NULL").select("file", (F.col("before") + F.col("bad") - F.col("first") + 1).alias("line"))
    row = found.orderBy("file", "line").limit(1).first()
    return (row["file"], row["line"]) if row else None


def read_jsonl(spark: SparkSession, path: str, schema: StructType | None = None, strict: bool = True) -> DataFrame:
    """One JSON record a line, blank lines skipped; ``strict``: a bad line is an error that names its file and line.

    Files are read in splits; strict reading first checks all lines in a pass of its own.
    """
    if strict and (bad := bad_json_line(spark, path)):
        raise ValueError(f"bad JSON in {bad[0]}, line {bad[1]}")
    reader = spark.read.option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def combine_jsonl(df: DataFrame, key: str, year: Column, position: Column) -> DataFrame:
    """First record of each id in the order of (year, position); records without an id all stay."""
    has = F.coalesce(F.col(key), F.lit("")) != ""
    place = F.row_number().over(Window.partitionBy(key).orderBy(year, position))
    first = df.where(has).withColumn("_r", place).where("_r = 1").drop("_r")
    return first.unionByName(df.where(~has))  # rows without an id are no group


def side_schema(spark: SparkSession, path: str, sep: str = "¿", quote: str = "¬") -> list[str]:
    """Column names from a side file: the first cell of each non-blank line."""
    cell = F.regexp_replace(F.substring_index("value", sep, 1), f"^{quote}|{quote}$", "")
    return [r["c"] for r in spark.read.text(path).select(cell.alias("c")).where(F.trim("c") != "").collect()]  # one row a column


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; ``one_file`` is for report tables only."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, date: str, mode: str = "append") -> None:
    """JSON lines stamped with ``collection_date``."""
    df.withColumn("collection_date", F.lit(date)).write.mode(mode).json(path)


def write_by_year(df: DataFrame, path: str, keys: list[str], year: str, lo: int, hi: int, order: list[Column]) -> DataFrame:
    """One folder for each year in the range: the first record of each key (lower case), blank keys and all.

    Only the years written are replaced.  Returns counts by year: read, duplicates, written.
    """
    inside = df.where(F.col(year).between(lo, hi))
    place = F.row_number().over(Window.partitionBy(*[F.lower(F.trim(k)) for k in keys]).orderBy(*order))
    ranked = inside.withColumn("_r", place)
    ranked.where("_r = 1").drop("_r").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(year).parquet(path)
    return ranked.groupBy(year).agg(F.count("*").alias("read"), F.count_if(F.col("_r") > 1).alias("duplicates"), F.count_if(F.col("_r") == 1).alias("written"))


def find_files(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """``path, length`` of all files below a folder with one of the suffixes, in any case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return found.where(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
