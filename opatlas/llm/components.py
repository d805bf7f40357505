"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opatlas.llm.tables import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node that has a link: the smallest node reachable from it.

    ``links`` has two columns of node numbers, in any direction, repeated or not.  Each turn
    hooks all neighbours of a node to the smallest of them, first the larger neighbours, then the
    smaller ones (the "large star" and "small star" of Kiveris et al., 2014), until nothing
    changes; a turn moves a few numbers per link, and nothing but a count reaches the driver.
    """
    a, b = links.columns
    now = written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(),
        "links",
    )
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(smallest, "u").where("v <> m")
        small = hooked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(smallest.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "links")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(
        roots.select("node", F.col("node").alias("label"))
    )


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]
