"""Ranks in large strata and places in a whole order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import Scratch


def hash_ranks(df: DataFrame, stratum: str, digest: Column, ties: list[str], rank: str, size: str | None = None, cell_rows: int = 100_000) -> DataFrame:
    """``rank``: each row's place, from 1, in its stratum by ``digest`` (a hash in hexadecimal digits), then ``ties``; ``size``: the stratum's.

    Rows are dealt to cells by the digest's first digits, as many as make cells of about ``cell_rows`` rows: a cell's rows are
    ranked together, and start from the sum of the cells before it.  So a stratum of any size is many tasks, and the ranks
    are those of one window over it.  Null is a stratum.
    """
    digits = max(0, math.ceil(math.log(max(1, df.count()) / cell_rows, 16)))
    keyed = df.withColumns({"_digest": digest, "_cell": F.substring(digest, 1, digits)})
    own = Window.partitionBy("_stratum")
    cells = keyed.groupBy(F.col(stratum).alias("_stratum"), F.col("_cell").alias("_of")).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(own.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumns({"_before": before, "_cell_total": F.sum("_rows").over(own)})  # 16 ** digits rows a stratum at most
    met = keyed.join(cells, F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_cell") == F.col("_of")))
    within = F.row_number().over(Window.partitionBy(stratum, "_cell").orderBy("_digest", *ties))
    made = {rank: F.col("_before") + within} | ({size: F.col("_cell_total")} if size else {})
    return met.withColumns(made).drop("_digest", "_cell", "_stratum", "_of", "_rows", "_before", "_cell_total")


def sorted_places(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """``out``: each row's place, from 1, in the order of the whole table.

    Rows are dealt to ranges between sampled splitters, sorted and numbered within each range as they are written; only the
    ranges' sizes, one row a range, meet in one place.  Rows that the order doesn't tell apart share a range, so a stable order
    of many equal keys ends in a column that tells them apart, such as the row's old place.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # the partition, above 33 bits of the row's place in it
    with Scratch(spark, "ranges") as scratch:
        written = scratch.kept(ranged.withColumns({"_range": F.shiftright(place, 33), "_at": place.bitwiseAND(F.lit((1 << 33) - 1).cast("long"))}))
    sizes = written.groupBy("_range").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = written.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")  # no more rows than shuffle partitions
    return placed.select(*df.columns, (F.col("_before") + F.col("_at") + 1).alias(out))
