"""Variables declared by operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opatlas import fixed_values as V
from opatlas.functions import brackets as B
from opatlas.functions.columns import all_matches, let

_HEADERS = "array<struct<operation_type:string,operation_name:string,block:string>>"
_VARIABLES = "array<struct<variable:string,declared:string>>"


def with_text(found: DataFrame) -> DataFrame:
    """Findings whose body is operation text, not the snippet of a hash or an id."""
    return found.where(
        (F.col("operation_body") != "") & ~F.col("operation_type").isin("doc_id", "persisted")
    )


def headers(body: Column) -> Column:
    """Type, name and variable block of every operation header in a document.

    The block reaches to the parenthesis that closes it, outside of strings and at any depth.
    """

    def read(tokens: Column) -> Column:
        def starts(place: Column) -> Column:
            return F.coalesce(F.get(tokens, place - 1).rlike(V.VARIABLE_HEADER), F.lit(False))

        def one(block: Column) -> Column:
            before = F.get(tokens, block["start"] - 1)
            return F.struct(
                F.regexp_extract(before, V.VARIABLE_HEADER, 1),
                F.regexp_extract(before, V.VARIABLE_HEADER, 2),
                B.joined(tokens, block["start"] + 1, block["stop"]),
            )

        return F.transform(B.covered(B.steps_of(tokens, "(", ")", whole=True), starts, closed=True), one).cast(_HEADERS)

    nothing = F.array().cast(_HEADERS)
    return F.when(body.contains("("), let(all_matches(body, B.ROUND_TOKEN), read)).otherwise(nothing)


def declared_type(text: Column) -> Column:
    """Type text without its default value and trailing separators."""
    return F.regexp_replace(F.regexp_replace(text, r"\s*=[\s\S]*$", ""), r"[,\s]+$", "")


def variables_in(block: Column) -> Column:
    """Names and type texts; strings, which only defaults hold, are emptied first."""
    block = F.regexp_replace(block, B.STRING_TOKEN, '""')
    return F.arrays_zip(
        all_matches(block, V.VARIABLE, 1), all_matches(block, V.VARIABLE, 2)
    ).cast(_VARIABLES)


def base_type(declared: Column) -> Column:
    """Type name without list brackets and non-null marks."""
    return F.trim(F.regexp_replace(declared, r"[!\[\]]", ""))


def own_block(body: Column, operation_type: Column, operation_name: Column) -> Column:
    """Variable block of the operation with this type and name; an unnamed header fits any name."""
    fitting = F.filter(
        headers(body),
        lambda h: (h["operation_type"] == operation_type)
        & h["operation_name"].isin(operation_name, F.lit("")),
    )
    return F.get(fitting, 0)["block"]


def variables(found: DataFrame) -> DataFrame:
    """Variable catalogue: (operation_type, operation_name, position, variable, variable_type)."""
    block = own_block(F.col("operation_body"), F.col("operation_type"), F.col("operation_name"))
    rows = (
        with_text(found)
        .select("operation_type", "operation_name", "operation_body")
        .distinct()
        .select("operation_type", "operation_name", F.posexplode(variables_in(block)).alias("position", "v"))
    )
    return rows.select(
        "operation_type",
        "operation_name",
        F.col("position").cast("bigint").alias("position"),
        F.col("v.variable").alias("variable"),
        declared_type(F.col("v.declared")).alias("variable_type"),
    ).distinct()


def placeholder(declared: Column) -> Column:
    base = base_type(declared)
    value = F.lit(V.OBJECT_PLACEHOLDER)
    for name, text in V.PLACEHOLDERS.items():
        value = F.when(base == name, text).otherwise(value)
    return value


def variables_template(found: DataFrame) -> DataFrame:
    """A JSON object with a placeholder for each variable, per operation text."""
    block = own_block(F.col("operation_body"), F.col("operation_type"), F.col("operation_name"))

    def entry(v: Column) -> Column:
        return F.concat(
            F.lit('"'), v["variable"], F.lit('":'),
            let(declared_type(v["declared"]), placeholder),
        )

    entries = F.transform(F.coalesce(variables_in(block), F.array().cast(_VARIABLES)), entry)
    return (
        with_text(found)
        .select("operation_type", "operation_name", "operation_body")
        .distinct()
        .select(
            "operation_type",
            "operation_name",
            "operation_body",
            F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias("variables_template"),
        )
    )


def input_types(bodies: DataFrame) -> DataFrame:
    """Declared types that are no built-in scalar, with where they were first seen."""
    rows = bodies.select(
        "first_order", "first_ord", F.posexplode(headers(F.col("body"))).alias("header_no", "h")
    ).select(
        "first_order", "first_ord", "header_no", F.posexplode(variables_in(F.col("h.block"))).alias("var_no", "v")
    )
    name = base_type(declared_type(F.col("v.declared")))
    return (
        rows.select(
            name.alias("input_type"), F.struct("first_order", "first_ord", "header_no", "var_no").alias("seen")
        )
        .where((F.col("input_type") != "") & ~F.col("input_type").isin(V.BUILT_IN_SCALARS))
        .groupBy("input_type")
        .agg(F.min("seen").alias("seen"))
    )


def declarations(bodies: DataFrame) -> DataFrame:
    """(op_id, def_name, variable, declared_type), the last declaration of a name wins."""
    rows = bodies.select("op_id", F.explode(headers(F.col("body"))).alias("h")).select(
        "op_id",
        F.col("h.operation_name").alias("def_name"),
        F.posexplode(variables_in(F.col("h.block"))).alias("var_no", "v"),
    )
    return rows.groupBy("op_id", "def_name", F.col("v.variable").alias("variable")).agg(
        F.max_by(declared_type(F.col("v.declared")), "var_no").alias("declared_type")
    )
