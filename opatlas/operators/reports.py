"""Reports over captures and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opatlas.functions import classify as C
from opatlas.operators import gates, requests
from opatlas.operators.findings import KEY
from opatlas.session import materialize


def counts_cube(found: DataFrame) -> DataFrame:
    """Findings for every source x type choice, 'All' included, and the total next to it."""
    cube = found.cube("source", "operation_type").agg(
        F.count("*").alias("visible"),
        F.grouping("source").alias("all_sources"),
        F.grouping("operation_type").alias("all_types"),
    )
    # At most 7 x 7 rows are left here: the sources and types are fixed lists.
    total = F.max(F.when((F.col("all_sources") == 1) & (F.col("all_types") == 1), F.col("visible")))
    return cube.select(
        F.when(F.col("all_sources") == 1, "All").otherwise(F.col("source")).alias("source"),
        F.when(F.col("all_types") == 1, "All").otherwise(F.col("operation_type")).alias("operation_type"),
        "visible",
        total.over(Window.partitionBy()).alias("total"),
    )


def endpoint_inventory(exchanges: DataFrame) -> DataFrame:
    """API endpoints per host: first call, calls, and distinct operation names.

    The exchanges are read once: requests with the same items at the same place are counted
    and written down, then their operations are read from there.
    """
    posts = exchanges.where(gates.is_post() & gates.body_gate())
    found = requests.http_exchange_items(posts, keep_empty=True)
    places = materialize(
        found.groupBy("host", F.col("endpoint").alias("path"), "method", "items").agg(
            F.min("ts").alias("first_seen"), F.count("*").alias("n_calls")
        )
    )
    calls = places.groupBy("host", "path").agg(
        F.min("first_seen").alias("first_seen"), F.sum("n_calls").alias("n_calls")
    )
    items = requests.exploded(places.select("host", "path", "method", "items"))
    names = (
        C.classify(items, C.REQUEST_FORMS)
        .groupBy("host", "path")
        .agg(F.countDistinct("operation_name").alias("n_operations"))
    )
    same = F.col("c.host").eqNullSafe(F.col("n.host")) & (F.col("c.path") == F.col("n.path"))
    return calls.alias("c").join(names.alias("n"), same, "left").select(
        "c.host",
        "c.path",
        "first_seen",
        "n_calls",
        F.coalesce("n_operations", F.lit(0)).cast("bigint").alias("n_operations"),
    )


def import_tallies(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Outcome counts of an import: rows read, malformed, repeated, already stored, imported."""
    keys = rows.groupBy(*KEY).agg(
        F.count_if("is_valid").alias("n_valid"), F.count_if(~F.col("is_valid")).alias("n_malformed")
    )
    marked = keys.join(
        stored.select(*KEY).distinct().withColumn("is_stored", F.lit(True)), KEY, "left"
    )
    valid = F.col("n_valid") > 0
    known = F.coalesce("is_stored", F.lit(False))
    return marked.agg(
        F.coalesce(F.sum(F.col("n_valid") + F.col("n_malformed")), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("n_malformed"), F.lit(0)).alias("n_malformed"),
        F.coalesce(F.sum(F.when(known, F.col("n_valid")).otherwise(0)), F.lit(0)).alias("n_already_stored"),
        F.coalesce(F.sum(F.when(~known & valid, F.col("n_valid") - 1).otherwise(0)), F.lit(0)).alias("n_repeated"),
        F.count_if(~known & valid).alias("n_imported"),
    )
