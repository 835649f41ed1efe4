"""Sublinear TF-IDF in SQL functions: sparse vectors are arrays of indices and values."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import Scratch


#: Rows that a task holds, about: its distinct terms are in memory at once.
TASK_ROWS = 2_000


def words(text: Column, stop: list[str]) -> Column:
    """The words of a text: lower case, letters and numbers, without stop words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*stop) if stop else w != "")


def runs(words: Column, n: int) -> Column:
    """All words, then all runs of two, up to those of ``n``."""
    out, last = [words], words
    for k in range(2, n + 1):
        size = F.greatest(F.lit(0), F.size(words) - k + 1)
        last = F.zip_with(F.slice(last, 1, size), F.slice(words, k, size), lambda a, b: F.concat_ws(" ", a, b))
        out.append(last)
    return F.concat(*out)


def grams(text: Column, n: int, stop: list[str]) -> Column:
    """The word 1..n-grams of a text: lower case, letters and numbers, without stop words."""
    return runs(words(text, stop), n)


def tfidf_arrays(df: DataFrame, row: str, text: str, n: int = 2, min_df: int = 2, max_df: float = 0.9, vocabulary: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """``(vectors, terms)``: ``row, indices, values`` of every row of ``df`` (rows are one for each ``row``), and ``index, term, df``.

    Terms of at least ``min_df`` rows and at most ``max_df`` of them, the ``vocabulary`` most frequent (ties in the order of the
    terms).  Counts are ``1 + ln(tf)``, weights ``ln((N + 1) / (df + 1)) + 1``, vectors of unit length.  Texts are dealt to tasks by
    their row, split once, and never taken apart over the network: only sums of terms meet, and the terms, a bounded table, are
    broadcast.  Both results are written.
    """
    spark = df.sparkSession
    stop = StopWordsRemover.loadDefaultStopWords("english")
    rows = df.count()
    parts = max(-(-rows // TASK_ROWS), spark.sparkContext.defaultParallelism)
    with Scratch(spark, "terms") as scratch:
        split = scratch.write(df.select(F.col(row).alias("row"), F.col(text).alias("text")).repartition(parts, "row").select("row", words(F.col("text"), stop).alias("words")))
        listed = split.select(runs(F.col("words"), n).alias("grams"))
        each = listed.select(F.size("grams").alias("size"), F.concat("grams", F.array_distinct("grams")).alias("both")).select("size", F.posexplode("both").alias("at", "term"))
        known = each.groupBy("term").agg(F.count_if(F.col("at") >= F.col("size")).alias("df"), F.count_if(F.col("at") < F.col("size")).alias("n"))
        best = known.where((F.col("df") >= min_df) & (F.col("df") <= max_df * rows)).orderBy(F.desc("n"), "term").limit(vocabulary)
        terms = scratch.kept(best.select((F.row_number().over(Window.orderBy(F.desc("n"), "term")) - 1).alias("index"), "term", "df"))  # at most ``vocabulary`` rows
        told = terms.select("term", "index", (F.log(F.lit(rows + 1.0) / (F.col("df") + 1)) + 1).alias("idf"))
        own = split.repartition(parts, "row").select("row", F.explode_outer(runs(F.col("words"), n)).alias("term")).join(F.broadcast(told), "term", "left")
        cells = own.groupBy("row", "index", "idf").agg(F.count("*").alias("tf"))  # where the row is, as it has all its terms there
        cell = F.when(F.col("index").isNotNull(), F.struct("index", ((1 + F.log("tf")) * F.col("idf")).alias("w")))
        vectors = cells.groupBy("row").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
        norm = F.sqrt(F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["w"] * c["w"]))
        values = F.zip_with("cells", F.array_repeat(norm, F.size("cells")), lambda c, whole: c["w"] / whole)  # inside the function the norm would be summed anew for each cell
        vectors = vectors.select("row", F.transform("cells", lambda c: c["index"]).alias("indices"), values.alias("values"))
        return scratch.kept(vectors), terms
