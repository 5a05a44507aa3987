"""Dense numbers and running totals over a whole table without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, value: str, order: str, name: str, width: int = 4096) -> DataFrame:
    """df with the sum of value over all rows of a smaller order; order is a non-negative long without repeats.

    Rows are summed by ranges of order, ranges by a window over the short table of ranges, and rows within their range.
    """
    part = (F.col(order) / width).cast("long")
    ranges = df.groupBy(part.alias("_range")).agg(F.sum(value).alias("_sum"))
    before = ranges.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_range", part).join(before, "_range").withColumn(name, (F.col("_before") + own).cast("long")).drop("_range", "_before")


def path_index(files: DataFrame) -> DataFrame:
    """files with path_index: the place of their path in the order of path components, from 0.

    Folders with the first characters of names are counted; the counts' running sum numbers files from the start of theirs.
    """
    parts = F.split("path", "/")
    keyed = files.withColumn("_dir", F.slice(parts, 1, F.size(parts) - 1)).withColumn("_name", F.element_at(parts, -1)).withColumn("_head", F.substring("_name", 1, 3))
    heads = keyed.groupBy("_dir", "_head").agg(F.count("*").alias("_n"))
    starts = heads.select("_dir", "_head", F.coalesce(F.sum("_n").over(Window.orderBy("_dir", "_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    row = F.row_number().over(Window.partitionBy("_dir", "_head").orderBy("_name"))
    return keyed.join(starts, ["_dir", "_head"]).withColumn("path_index", F.col("_start") + row - 1).drop("_dir", "_name", "_head", "_start")
