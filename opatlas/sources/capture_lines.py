"""Script captures stored as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opatlas import fixed_values as V
from opatlas.functions import brackets as B
from opatlas.functions import classify as C
from opatlas.functions.columns import all_matches, let
from opatlas.operators.gates import is_operation
from opatlas.session import materialize
from opatlas.sources.lines import PLACE, text_lines, with_line_numbers

_BAD = "_bad"
_FIELDS = "query: STRING, doc_id: STRING, operationName: STRING"
_OBJECT = f"struct<{_FIELDS}, {_BAD}: STRING>"
_ELEMENT = f"struct<{_FIELDS}>"
_BRACE_TOKEN = B.STRING_TOKEN + r'|[{}]|[^{}"]++'
_ITEM = "struct<form:string,text:string,name:string,hash:string>"


def read_capture_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.text(path).select(F.trim("value").alias("line"))


def _has_text(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _query_item(capture: Column) -> Column:
    return F.struct(
        F.lit(C.PLAIN), capture["query"], capture["operationName"], F.lit(None)
    ).cast(_ITEM)


def _id_item(capture: Column) -> Column:
    name = F.when(_has_text(capture["operationName"]), capture["operationName"]).otherwise(V.ANONYMOUS)
    snippet = F.concat(F.lit("doc_id: "), capture["doc_id"], F.lit(" ("), name, F.lit(")"))
    return F.struct(F.lit(C.DOC_ID), snippet, name, capture["doc_id"]).cast(_ITEM)


def _objects_in(array: Column) -> Column:
    """The objects of a JSON array and of the arrays inside of it, at any depth, in their order.

    Only arrays are entered, so they are the outermost braces outside of strings.
    """

    def read(tokens: Column) -> Column:
        blocks = B.covered(B.steps_of(tokens, "{", "}", whole=True), lambda place: F.get(tokens, place) == "{", closed=True)
        return F.transform(
            blocks,
            lambda b: F.from_json(B.joined(tokens, b["start"], b["stop"] + 1), _ELEMENT, {"mode": "PERMISSIVE"}),
        )

    return let(all_matches(array, _BRACE_TOKEN), read)


def parsed_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with their ``items`` and whether they are ``broken``.

    Items are those of object lines (one each) and of array lines (queries and ids of every object in
    them, however deep in arrays).  In an object line the query counts and the id only without one.  In
    an array a query has to be an operation by itself.  A line that is no JSON object or array, or a
    broken one, is rejected; blank lines are neither.
    """
    line = F.col("line")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    parsed = lines.select(
        *lines.columns,
        F.when(line.startswith("{"), F.from_json(line, _OBJECT, options)).alias("object"),
        F.when(line.startswith("[") & F.from_json(line, "array<string>").isNotNull(), _objects_in(line)).alias("objects"),
    )
    one = F.col("object")
    from_object = F.when(
        one[_BAD].isNull(),
        F.when(_has_text(one["query"]), _query_item(one)).when(_has_text(one["doc_id"]), _id_item(one)),
    )
    from_array = F.flatten(
        F.transform(
            F.filter("objects", lambda o: o.isNotNull()),
            lambda o: F.array(
                F.when(is_operation(o["query"]), _query_item(o)), F.when(_has_text(o["doc_id"]), _id_item(o))
            ),
        )
    )
    is_object = one.isNotNull() & one[_BAD].isNull()
    return parsed.select(
        *lines.columns,
        F.coalesce(from_array, F.array(from_object)).alias("items"),
        ((line != "") & ~is_object & F.col("objects").isNull()).alias("broken"),
    )


def capture_items(lines: DataFrame) -> DataFrame:
    """Items of the lines, one row each; see :func:`parsed_lines`."""
    parsed = lines if "items" in lines.columns else parsed_lines(lines)
    items = parsed.select(F.posexplode("items").alias("item_no", "item"))
    return items.where("item is not null").select(
        C.item_order(F.lit(0), F.col("item_no")).alias("ord"), "item.*"
    )


def ingested(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(parsed lines, rejected lines) of the files below ``path``, from one pass over them.

    A rejected line is (file, line_no, text).  Lines are written down with their places; a whole line
    is kept only where it is rejected.
    """
    lines = text_lines(spark, path).withColumn("line", F.trim("value")).drop("value")
    parsed = parsed_lines(lines)
    stored = materialize(parsed.select(*PLACE, "items", F.when(F.col("broken"), F.col("line")).alias("text")))
    rejected = with_line_numbers(stored).where("text is not null").select("file", "line_no", "text")
    return stored.select("items"), rejected


def capture_line_ops(lines: DataFrame) -> DataFrame:
    """Distinct operations of the lines, with how often each was captured."""
    items = capture_items(lines).drop("ord")
    distinct = items.groupBy(*items.columns).agg(F.count("*").alias("n")).withColumn("ord", F.lit(0))
    return (
        C.classify(distinct, C.REQUEST_FORMS)
        .groupBy(
            "operation_type", "operation_name",
            F.coalesce("persisted_hash", F.lit("")).alias("persisted_hash"), "operation_body",
        )
        .agg(F.sum("n").alias("n_captures"))
    )
