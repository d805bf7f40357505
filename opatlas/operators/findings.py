"""Findings: deduplicated operations.

A *partial finding* holds one key's share of the input: who came first, the longest body,
counts and times.  Partials of any two inputs merge into the partial of their union, which
is what batch, incremental and streaming runs all use.

    key      endpoint, operation_name, operation_type, persisted_hash ('' for none)
    first    url, method, source, first_order, first_ord
    longest  operation_body, body_order, body_ord
    tallies  first_seen, last_seen, n_seen
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opatlas import fixed_values as V
from opatlas.functions import classify as C
from opatlas.functions.columns import in_order
from opatlas.operators import requests
from opatlas.session import materialize

KEY = ["endpoint", "operation_name", "operation_type", "persisted_hash"]
_ORDER = ["capture_id", "ts", "host"]


def distinct_exchanges(found: DataFrame) -> DataFrame:
    """Exchanges whose items are equal in one row, with their first arrival and count.

    Traffic repeats itself: the same operation text arrives from every client.  Grouping
    before classification makes the costly text work proportional to distinct requests, and
    the map-side half of the aggregate takes the weight out of hot keys before the shuffle.
    All buffers are fixed-width, so this stays a hash aggregate.  ``unit`` tells the rows apart; it is
    a row number, so it holds once the table is written down.
    """
    content = [c for c in found.columns if c not in _ORDER]
    grouped = found.groupBy(*content).agg(
        F.min(in_order(F.col("ts"), F.col("capture_id"))).alias("first_order"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.count("*").alias("n_seen"),
    )
    return grouped.withColumn("unit", F.monotonically_increasing_id())


def from_ops(ops: DataFrame) -> DataFrame:
    """Partial findings from operations that carry their arrival and count."""
    if "first_order" not in ops.columns:
        ops = ops.withColumns(
            {
                "first_order": in_order(F.col("ts"), F.col("capture_id")),
                "first_seen": F.col("ts"),
                "last_seen": F.col("ts"),
                "n_seen": F.lit(1).cast("bigint"),
            }
        )
    return ops.select(
        "endpoint",
        "operation_name",
        "operation_type",
        F.coalesce("persisted_hash", F.lit("")).alias("persisted_hash"),
        "url",
        "method",
        "source",
        "first_order",
        F.col("ord").alias("first_ord"),
        "operation_body",
        F.col("first_order").alias("body_order"),
        F.col("ord" if "body_ord" not in ops.columns else "body_ord").alias("body_ord"),
        "first_seen",
        "last_seen",
        "n_seen",
    )


def once_per(ops: DataFrame, unit: list[str]) -> DataFrame:
    """One row for each key of a unit (a distinct request, a script): what came first, and the
    longest body.  So a key counts once for every exchange, however often a unit holds it."""
    key = ["operation_name", "operation_type", "persisted_hash"]
    rest = [c for c in ops.columns if c not in [*unit, *key, "source", "ord", "operation_body"]]
    longest = F.struct(F.length("operation_body"), -F.col("ord"))
    found = ops.withColumn("persisted_hash", F.coalesce("persisted_hash", F.lit(""))).groupBy(*unit, *key).agg(
        F.min_by(F.struct("source", "ord"), F.col("ord")).alias("first"),
        F.max_by(F.struct("operation_body", F.col("ord").alias("body_ord")), longest).alias("longest"),
        *[F.first(c).alias(c) for c in rest],  # the same in all rows of a unit
    )
    return found.select(*unit, *key, "first.*", "longest.*", *rest)


def merge(partials: DataFrame) -> DataFrame:
    """One finding per key: the first arrival's origin and the longest body, ties to the earlier."""
    arrival = F.struct("first_order", "first_ord")
    longest = F.struct(
        F.length("operation_body"), -F.col("body_order"), -F.col("body_ord")
    )
    merged = partials.groupBy(*KEY).agg(
        F.min_by(F.struct("url", "method", "source", "first_order", "first_ord"), arrival).alias("first"),
        F.max_by(F.struct("operation_body", "body_order", "body_ord"), longest).alias("longest"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("n_seen").alias("n_seen"),
    )
    return merged.select(*KEY, "first.*", "longest.*", "first_seen", "last_seen", "n_seen")


_CONTENT = ["form", "text", "name", "hash"]


def with_item_id(items: DataFrame) -> DataFrame:
    """``item_id``: a hash of the content; lengths tell its parts apart, and -1 a null from an empty one."""

    def size(name: str) -> Column:
        return F.coalesce(F.length(name), F.lit(-1))

    content = F.concat_ws(" ", "form", size("text"), "text", size("name"), "name", "hash")
    return items.withColumn("item_id", F.unhex(F.sha2(content, 256)))


def item_operations(items: DataFrame) -> DataFrame:
    """Operations of every distinct item, by ``item_id``: each text is classified once, at however
    many URLs, endpoints and places in a request it was found."""
    distinct = items.groupBy("item_id").agg(*[F.first(c).alias(c) for c in _CONTENT])
    return C.classify(distinct.withColumn("ord", F.lit(0)), C.REQUEST_FORMS)


def findings_of_exchanges(found: DataFrame) -> DataFrame:
    """Partial findings of the items of requests and messages, one array per exchange.

    Equal exchanges are one unit and written down; from there the distinct items are classified, and
    their operations joined back to the units that hold them.
    """
    units = materialize(distinct_exchanges(found))
    items = with_item_id(requests.exploded(units))
    ops = item_operations(items).withColumnRenamed("ord", "op_ord")
    placed = items.drop(*_CONTENT).join(ops, "item_id").withColumn("ord", F.col("ord") + F.col("op_ord"))
    return from_ops(once_per(placed.drop("item_id", "op_ord"), ["unit"]))


def new_keys(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Findings whose key is not stored yet."""
    return found.join(stored.select(*KEY), KEY, "left_anti")


def source_label(source: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in V.SOURCE_LABELS.items() for x in pair])
    return F.element_at(labels, source)


def source_of_label(label: Column) -> Column:
    """Source of a label; unknown labels count as request bodies."""
    sources = F.create_map(
        *[F.lit(x) for source, text in V.SOURCE_LABELS.items() for x in (text, source)]
    )
    return F.coalesce(F.try_element_at(sources, label), F.lit(V.DEFAULT_SOURCE))


def filter_findings(
    found: DataFrame, label: str | None = None, operation_type: str | None = None
) -> DataFrame:
    """Findings of one source label and/or one operation type; None means all."""
    if label is not None:
        found = found.where(source_label(F.col("source")) == label)
    if operation_type is not None:
        found = found.where(F.col("operation_type") == operation_type)
    return found


def numbered(df: DataFrame, order: list[str], number: str) -> DataFrame:
    """Row numbers over a total order, without sending all rows through one task.

    The rows are range-partitioned and sorted, each remembers its partition and position,
    and that is written down once (a second evaluation could choose other ranges).  Then a
    running total over the partition sizes turns positions into numbers.
    """
    position = F.monotonically_increasing_id()
    placed = materialize(
        df.orderBy(*order)
        .withColumn("_at", position)
        .withColumn("_part", F.shiftright("_at", 33))
        .withColumn("_at", F.col("_at").bitwiseAND(F.lit(2**33 - 1)))
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.join(F.broadcast(offsets), "_part")  # one row per shuffle partition
        .withColumn(number, F.col("_offset") + F.col("_at") + 1)
        .drop("_part", "_at", "_offset")
    )


def findings_table(found: DataFrame) -> DataFrame:
    """The table as users see it, numbered in arrival order."""
    rows = numbered(found, ["first_order", "first_ord", *KEY], "row_no")
    return rows.select(
        "row_no",
        F.date_format("first_seen", V.DISPLAY_TIME).alias("seen_at"),
        "endpoint",
        "method",
        source_label(F.col("source")).alias("source_label"),
        "operation_type",
        "operation_name",
        "persisted_hash",
        "operation_body",
    )


def sorted_by(table: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """The table sorted by any of its columns; text sorts as text."""
    return table.orderBy(F.col(column).desc() if descending else F.col(column).asc(), "row_no")
