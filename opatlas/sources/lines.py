"""Text files as lines that know where they stand.

Files are read in splits, so a line's number in its file is known only when the lines before its split
are counted.  Each line carries its file, its split and its place in the task's input; once a table of
them is written down, counts of the splits turn places into line numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACE = ["file", "block", "row"]


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the files below ``path``, blank ones included: (value, file, block, row)."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def with_line_numbers(rows: DataFrame) -> DataFrame:
    """``rows``, a written table with one row for each line, with ``line_no`` from 1 in each file.

    A task reads a split from its start to its end, so its lines have consecutive places.
    """
    splits = rows.groupBy("file", "block").agg(F.min("row").alias("first_row"), F.count("*").alias("n_lines"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.select(
        "file", "block", (F.coalesce(F.sum("n_lines").over(earlier), F.lit(0)) - F.col("first_row") + 1).alias("shift")
    )
    # one row for each split
    return rows.join(F.broadcast(begins), ["file", "block"]).withColumn("line_no", F.col("row") + F.col("shift")).drop("shift")
