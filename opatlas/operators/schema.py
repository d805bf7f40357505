"""Partial schema inferred from operation texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opatlas import fixed_values as V
from opatlas.functions.columns import without_first, without_last
from opatlas.functions.text import capitalize
from opatlas.operators import tokens
from opatlas.operators.findings import numbered
from opatlas.operators.variables import declarations, input_types
from opatlas.session import materialize

_SEEN = ["first_order", "first_ord", "pos"]


def response_type(field: Column) -> Column:
    return F.concat(capitalize(field), F.lit("_Response"))


def _type_at(path: Column) -> Column:
    """Name of the object type whose fields have this path; null for the root of an operation."""
    steps = F.transform(path, capitalize)
    in_operation = F.array_join(
        F.concat(F.array(response_type(F.get(path, 0))), without_first(steps)), "_"
    )
    in_fragment = F.array_join(F.concat(F.array("on_type"), steps), "_")
    return F.when(F.col("def_type") == "fragment", in_fragment).when(F.size(path) > 0, in_operation)


def typed_selections(bodies: DataFrame) -> DataFrame:
    """Selections with the type each belongs to.

    type_name is null at the root of an operation; owner_type and owner name the field that
    leads to the type.
    """
    path = F.col("path")
    outer = without_last(path)
    return tokens.selections(bodies).select(
        "*",
        _type_at(path).alias("type_name"),
        F.when(F.size(path) > 0, _type_at(outer)).alias("owner_type"),
        F.when(F.size(path) > 0, F.element_at(path, -1)).alias("owner"),
    )


def schema_types(rows: DataFrame) -> DataFrame:
    """Object types in order of their first appearance; only meta fields leave a type empty."""
    return (
        rows.where("kind = 'field' and type_name is not null")
        .groupBy("type_name")
        .agg(
            F.min(F.struct("first_order", "first_ord", "owner_pos")).alias("type_seen"),
            F.count_if(~F.col("is_meta")).alias("n_uses"),
        )
    )


def schema_fields(rows: DataFrame) -> DataFrame:
    """(type_name, field, return_type, seen): a field has its own type once any use shows children.

    Each selected field stands for itself and for the fact that its owner has children, so
    one aggregation gives both.
    """
    uses = rows.where("kind = 'field'").select(
        F.explode(
            F.array(
                F.struct(
                    "type_name", F.col("name").alias("field"), F.col("is_meta"),
                    F.struct(*_SEEN).alias("seen"), F.lit(False).alias("has_children"),
                ),
                F.struct(
                    F.col("owner_type").alias("type_name"), F.col("owner").alias("field"),
                    F.lit(False).alias("is_meta"),
                    F.struct("first_order", "first_ord", F.col("owner_pos").alias("pos")).alias("seen"),
                    F.lit(True).alias("has_children"),
                ),
            )
        ).alias("u")
    ).select("u.*")
    fields = (
        uses.where("type_name is not null and field is not null and not is_meta")
        .groupBy("type_name", "field")
        .agg(F.min("seen").alias("seen"), F.max("has_children").alias("has_children"))
    )
    child_type = F.concat("type_name", F.lit("_"), capitalize(F.col("field")))
    return fields.select(
        "type_name",
        "field",
        F.when(F.col("has_children"), child_type).otherwise(V.UNKNOWN).alias("return_type"),
        "seen",
    )


def schema_root(rows: DataFrame, types: DataFrame) -> DataFrame:
    """(root, field, return_type, seen) for the root types.

    The return type is known once a type of that name has fields, whichever root showed them.
    """
    fields = (
        rows.where("kind = 'field' and type_name is null and not is_meta")
        .groupBy(F.col("def_type").alias("root"), F.col("name").alias("field"))
        .agg(F.min(F.struct(*_SEEN)).alias("seen"))
        .withColumn("candidate", response_type(F.col("field")))
    )
    filled = types.where("n_uses > 0").select(F.col("type_name").alias("candidate"), F.lit(True).alias("has_fields"))
    return fields.join(filled, "candidate", "left").select(
        "root",
        "field",
        F.when(F.col("has_fields"), F.col("candidate")).otherwise(V.UNKNOWN).alias("return_type"),
        "seen",
    )


def literal_type(value: Column) -> Column:
    return (
        F.when(value.rlike("^-?[0-9]+$"), "Int")
        .when(value.rlike(r"^-?[0-9]+\.[0-9]+$"), "Float")
        .when(value.isin("true", "false"), "Boolean")
        .when(value.startswith('"'), "String")
        .when(value.rlike("^[A-Z_][A-Z0-9_]*$"), "String")
        .otherwise(V.UNKNOWN)
    )


def schema_args(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """(type_name, field, argument, argument_type, seen); the first use of an argument decides.

    type_name is the root type's name for root fields.  A variable's type is looked up in
    the declarations of its own operation.
    """
    roots = F.create_map(*[F.lit(x) for pair in V.ROOT_TYPES.items() for x in pair])
    uses = rows.where("kind = 'argument' and not is_meta").select(
        "op_id",
        "def_name",
        F.coalesce("type_name", F.element_at(roots, F.col("def_type"))).alias("type_name"),
        F.col("name").alias("field"),
        F.col("alias").alias("argument"),
        "value",
        F.when(F.col("value").startswith("$"), F.substring("value", 2, 2**31 - 1)).alias("variable"),
        F.struct(*_SEEN).alias("seen"),
    )
    typed = uses.join(declared, ["op_id", "def_name", "variable"], "left").withColumn(
        "argument_type",
        F.when(F.col("variable").isNotNull(), F.coalesce("declared_type", F.lit(V.UNKNOWN))).otherwise(
            literal_type(F.col("value"))
        ),
    )
    return typed.groupBy("type_name", "field", "argument").agg(
        F.min_by("argument_type", "seen").alias("argument_type"), F.min("seen").alias("seen")
    )


def schema_inputs(bodies: DataFrame, types: DataFrame) -> DataFrame:
    """(input_type, seen): declared input types that are no object type."""
    return input_types(bodies).join(
        types.select(F.col("type_name").alias("input_type")), "input_type", "left_anti"
    )


PREAMBLE = [
    "# Inferred schema (partial)",
    "# Built from the operations seen in captured traffic; fields nobody used are missing.",
    "# 'Unknown' marks leaf fields, whose type the traffic does not show.",
    "",
    "scalar Unknown",
    "",
]
INPUT_COMMENT = "# Input type seen in variable declarations; its fields are unknown"
_PLACE = "struct<first_order:decimal(38,0),first_ord:bigint,pos:int,extra:int>"


def _place(seen: Column | None = None) -> Column:
    """Order of a line inside its section; null sorts first."""
    if seen is None:
        return F.lit(None).cast(_PLACE)
    return seen.cast(_PLACE)


def _lines(df: DataFrame, section: Column, block: Column, item: Column, lines: list[Column]) -> DataFrame:
    """Rows (section, block, item, step, line): ``lines`` in order at one place of the text."""
    return df.select(
        section.cast("int").alias("section"),
        block.alias("block"),
        item.alias("item"),
        F.posexplode(F.array(*lines)).alias("step", "line"),
    )


def schema_lines(found: DataFrame) -> DataFrame:
    """The schema as text: (line_no, line), types and fields in first-seen order."""
    spark = found.sparkSession
    bodies = materialize(tokens.distinct_bodies(found))
    rows = materialize(typed_selections(bodies))
    types = schema_types(rows)
    fields = schema_fields(rows)
    root = schema_root(rows, types)
    args = schema_args(rows, declarations(bodies))
    inputs = schema_inputs(bodies, types)

    seen = F.col("seen")
    widen = F.struct(seen["first_order"], seen["first_ord"], seen["pos"], F.lit(0))
    one_arg = F.concat("argument", F.lit(": "), "argument_type")
    # The arguments of one field end up in one line of the text in any case.
    arg_lists = args.groupBy("type_name", "field").agg(
        F.array_sort(F.collect_list(F.struct("seen", "argument", one_arg.alias("text")))).alias("args")
    ).select("type_name", "field", F.concat(F.lit("("), F.array_join(F.col("args.text"), ", "), F.lit(")")).alias("args"))

    roots = list(V.ROOT_TYPES)
    root_name = F.create_map(*[F.lit(x) for pair in V.ROOT_TYPES.items() for x in pair])
    root_section = F.array_position(F.array(*[F.lit(r) for r in roots]), F.col("root")) + 1

    def field_line(df: DataFrame) -> DataFrame:
        return df.join(arg_lists, ["type_name", "field"], "left").withColumn(
            "line",
            F.concat(F.lit("  "), "field", F.coalesce("args", F.lit("")), F.lit(": "), "return_type"),
        )

    root_fields = field_line(root.withColumn("type_name", F.element_at(root_name, F.col("root"))))
    present = root.select("root").distinct()
    filled = types.where("n_uses > 0").withColumn(
        "type_place",
        _place(F.struct(F.col("type_seen.first_order"), F.col("type_seen.first_ord"), F.col("type_seen.owner_pos"), F.lit(0))),
    )
    object_fields = field_line(fields).join(filled.select("type_name", "type_place"), "type_name")
    preamble = spark.createDataFrame([(i, line) for i, line in enumerate(PREAMBLE)], "step int, line string")

    nothing = _place()
    last = _place(F.struct(F.lit("9" * 38).cast("decimal(38,0)"), F.lit(0), F.lit(0), F.lit(0)))
    any_root = present.limit(1)
    type_open = F.concat(F.lit("type "), F.col("type_name"), F.lit(" {"))
    parts = [
        preamble.select(F.lit(0).alias("section"), nothing.alias("block"), nothing.alias("item"), "step", "line"),
        _lines(any_root, F.lit(1), nothing, nothing, [F.lit("schema {")]),
        _lines(
            present, F.lit(1), nothing,
            _place(F.struct(F.lit(0).cast("decimal(38,0)"), F.lit(0), root_section.cast("int"), F.lit(0))),
            [F.concat(F.lit("  "), "root", F.lit(": "), F.element_at(root_name, F.col("root")))],
        ),
        _lines(any_root, F.lit(1), nothing, last, [F.lit("}"), F.lit("")]),
        _lines(
            present, root_section, nothing, nothing,
            [F.concat(F.lit("type "), F.element_at(root_name, F.col("root")), F.lit(" {"))],
        ),
        _lines(root_fields, root_section, nothing, _place(widen), [F.col("line")]),
        _lines(present, root_section, nothing, last, [F.lit("}"), F.lit("")]),
        _lines(filled, F.lit(5), F.col("type_place"), nothing, [type_open]),
        _lines(object_fields, F.lit(5), F.col("type_place"), _place(widen), [F.col("line")]),
        _lines(filled, F.lit(5), F.col("type_place"), last, [F.lit("}"), F.lit("")]),
        _lines(
            inputs, F.lit(6),
            _place(F.struct(seen["first_order"], seen["first_ord"], seen["header_no"], seen["var_no"])),
            nothing,
            [
                F.lit(INPUT_COMMENT),
                F.concat(F.lit("input "), "input_type", F.lit(" {")),
                F.lit("  _placeholder: Unknown"),
                F.lit("}"),
                F.lit(""),
            ],
        ),
    ]
    text = parts[0]
    for part in parts[1:]:
        text = text.unionByName(part)
    return numbered(text, ["section", "block", "item", "step", "line"], "line_no").select("line_no", "line")


def write_schema(found: DataFrame, path: str) -> None:
    """Write the schema as text files whose names sort in line order."""
    schema_lines(found).orderBy("line_no").select("line").write.text(path)
