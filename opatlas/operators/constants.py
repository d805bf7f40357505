"""Operations assembled from string constants, resolved as joins.

Scripts build operations as ``"query A {".concat(x).concat(cond ? y : "")``.  The string
constants of a bundle form one table, the links of its concat chains another; joining them
on (bundle, name) and gluing the links in order gives the assembled text.  Nothing is run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opatlas import fixed_values as V
from opatlas.functions import brackets as B
from opatlas.functions import classify as C
from opatlas.functions import text as T
from opatlas.functions.columns import all_matches, first_match, let
from opatlas.operators.gates import is_inline_fragment, is_operation
from opatlas.session import materialize

# A chain starts with a literal and a call; only the head is consumed, so chains inside the
# arguments of another chain are found as well.
CHAIN_HEAD = '"' + V.STRING_RUN_OR_EMPTY + '"' + r"\s*\.concat\s*\("
CHAIN_BASE = '^"(' + V.STRING_RUN_OR_EMPTY + ')"'
NEXT_LINK = r"^\.concat\s*\($"

BASE_LINK = -1


def constant_rows(bundles: DataFrame) -> DataFrame:
    """Every string assignment, as (bundle_id, name, value, pass, pos)."""
    body = F.col("body")

    def assignments(pattern: str, pass_no: int) -> Column:
        pairs = F.arrays_zip(all_matches(body, pattern, 1), all_matches(body, pattern, 2))
        return F.struct(
            F.lit(pass_no).alias("pass"), pairs.cast("array<struct<name:string,raw:string>>").alias("pairs")
        )

    passes = bundles.select(
        "bundle_id",
        F.explode(
            F.array(assignments(V.DECLARED_CONSTANT, 0), assignments(V.PROPERTY_CONSTANT, 1))
        ).alias("found"),
    )
    rows = passes.select(
        "bundle_id", F.col("found.pass").alias("pass"), F.posexplode("found.pairs").alias("pos", "pair")
    )
    return rows.select(
        "bundle_id",
        F.col("pair.name").alias("name"),
        T.unescape_constant(F.col("pair.raw")).alias("value"),
        "pass",
        "pos",
    )


def constants(bundles: DataFrame) -> DataFrame:
    """One value per name: the last assignment wins, property assignments after declarations.

    ``first_at`` is where the name first appeared; it orders the captures made from constants.
    """
    at = F.struct("pass", "pos")
    return (
        constant_rows(bundles)
        .groupBy("bundle_id", "name")
        .agg(F.max_by("value", at).alias("value"), F.min(at).alias("first_at"))
    )


def constant_kinds(table: DataFrame) -> DataFrame:
    """Constants that are an operation or an inline fragment by themselves."""
    value = T.collapse_spaces(F.col("value"))
    kind = F.when(is_operation(value), "operation").when(is_inline_fragment(value), "fragment")
    return table.withColumn("kind", kind).where("kind is not null")


_OPENINGS = "array<struct<level:int,place:int,close:int,chain_no:int,base:string,argument:string>>"


def _openings(body: Column) -> Column:
    """Calls that start a chain of an operation, and calls right behind a closing parenthesis.

    Every piece of the text ends with one parenthesis, so a piece and its bracket share a place.
    """

    def parentheses(text: Column) -> Column:
        return F.length(text) - F.length(F.translate(text, "()", ""))

    def operation_heads(heads: Column, between: Column) -> Column:
        counts = F.transform(heads, lambda h, i: parentheses(F.get(between, i)) + parentheses(h))
        return let(
            B.running(counts),
            lambda upto: F.filter(
                F.transform(
                    heads,
                    lambda h, i: F.struct(
                        (F.get(upto, i) - 1).alias("place"),
                        i.alias("chain_no"),
                        T.replace_all(F.regexp_extract(h, CHAIN_BASE, 1), T.JSON_ESCAPES).alias("base"),
                    ),
                ),
                lambda h: is_operation(h["base"]),
            ),
        )

    def opening(parts: Column, found: Column, place: Column, chain_no: Column, base: Column) -> Column:
        own = F.get(found, place)
        inside = B.joined(parts, place + 1, own["partner"] + 1)
        argument = F.when(own["partner"].isNotNull(), F.left(inside, F.length(inside) - 1))
        return F.struct(own["level"], place, own["partner"], chain_no, base, argument)

    def all_openings(heads: Column, parts: Column, found: Column) -> Column:
        starts = F.transform(heads, lambda h: opening(parts, found, h["place"], h["chain_no"], h["base"]))
        calls = F.filter(
            found,
            lambda b: (b["partner"] > b["place"])
            & F.coalesce(F.get(parts, b["place"] - 1).endswith(")"), F.lit(False))
            & F.get(parts, b["place"]).rlike(NEXT_LINK),
        )
        nothing = F.lit(None)
        links = F.transform(calls, lambda b: opening(parts, found, b["place"], nothing.cast("int"), nothing.cast("string")))
        return F.concat(starts.cast(_OPENINGS), links.cast(_OPENINGS))

    def read(heads: Column) -> Column:
        cut = let(
            all_matches(body, B.ROUND_PIECE),
            lambda parts: let(B.pairs(B.steps_of(parts, "(", ")")), lambda found: all_openings(heads, parts, found)),
        )
        return F.when(F.size(heads) > 0, cut)

    heads = let(
        all_matches(body, CHAIN_HEAD), lambda h: let(F.split(body, CHAIN_HEAD, -1), lambda b: operation_heads(h, b))
    )
    return F.when(body.contains(".concat"), let(heads, read))


def chain_links(bundles: DataFrame) -> DataFrame:
    """Links of the concat chains that start with an operation.

    (bundle_id, chain_no, base, link_no, argument).  A chain goes on while a call stands right behind
    the parenthesis that closes the last one; such calls are neighbours on their level.  The first
    link is always there; its argument is null where its call never closes.
    """
    calls = bundles.select("bundle_id", F.explode(_openings(F.col("body"))).alias("c")).select("bundle_id", "c.*")
    order = Window.partitionBy("bundle_id", "level").orderBy("place")
    goes_on = F.col("chain_no").isNull() & (F.lag("close").over(order) == F.col("place") - 1)
    calls = calls.withColumn("begins", F.when(goes_on, 0).otherwise(1))
    calls = calls.withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    chain = Window.partitionBy("bundle_id", "level", "run").orderBy("place")
    links = calls.select(
        "bundle_id",
        F.first("chain_no").over(chain).alias("chain_no"),
        F.first("base").over(chain).alias("base"),
        (F.row_number().over(chain) - 1).alias("link_no"),
        "argument",
    )
    return links.where("chain_no is not null")


def conditional_values(argument: Column) -> Column:
    """Both values of ``condition ? value : value``, as an array; null for anything else.

    The marks are the first ones outside of strings and brackets, nested at any depth.
    """

    def split_at(tokens: Column, depths: Column) -> Column:
        def places(mark: str, after: Column) -> Column:
            outside = F.transform(
                tokens, lambda t, i: F.when((t == mark) & (F.get(depths, i) == 0) & (i > after), i)
            )
            return F.array_min(outside)

        return let(
            places("?", F.lit(-1)),
            lambda question: let(
                F.when(question.isNotNull(), places(":", question)),
                lambda colon: F.when(
                    colon.isNotNull(),
                    F.array(B.joined(tokens, question + 1, colon), B.joined(tokens, colon + 1, F.size(tokens))),
                ),
            ),
        )

    found = let(
        all_matches(argument, B.EXPRESSION_TOKEN),
        lambda tokens: let(
            B.running(B.steps_of(tokens, "([", ")]", whole=True)), lambda depths: split_at(tokens, depths)
        ),
    )
    return F.when(argument.contains("?"), found)


def _value(text: Column) -> Column:
    """A literal's content or an identifier, as struct<literal, name>; both null for the rest."""
    literal = F.when(
        text.rlike(V.WHOLE_STRING),
        T.replace_all(F.regexp_extract(text, V.WHOLE_STRING, 1), T.JSON_ESCAPES),
    )
    name = F.when(text.rlike(V.IDENTIFIER), text)
    return F.struct(literal.alias("literal"), name.alias("name"))


def chain_values(found: DataFrame) -> DataFrame:
    """Candidate values of every link: (bundle_id, chain_no, link_no, branch, literal, name, drop_blank)."""
    argument = F.col("argument")
    links = found.select("bundle_id", "chain_no", "link_no", F.trim("argument").alias("argument")).where("argument is not null")
    is_literal = argument.rlike(V.WHOLE_STRING)
    links = links.withColumn("sides", F.when(~is_literal, conditional_values(argument)))
    sides = F.col("sides")
    branches = F.transform(sides, lambda side: _value(F.trim(side)))
    values = links.select(
        "bundle_id",
        "chain_no",
        "link_no",
        (is_literal | sides.isNotNull()).alias("drop_blank"),
        F.posexplode(F.coalesce(branches, F.array(_value(argument)))).alias("branch", "value"),
    )
    return values.select(
        "bundle_id", "chain_no", "link_no", "branch",
        F.col("value.literal").alias("literal"), F.col("value.name").alias("name"), "drop_blank",
    ).where("literal is not null or name is not null")


def assembled(bundles: DataFrame, table: DataFrame) -> DataFrame:
    """Texts of all chains with their links resolved: (bundle_id, chain_no, query).

    The base literal takes part as a link of its own, so a chain whose links all stay
    unknown still keeps its base.
    """
    found = materialize(chain_links(bundles))
    bases = found.where("link_no = 0").select(
        "bundle_id", "chain_no", F.lit(BASE_LINK).alias("link_no"), F.lit(0).alias("branch"),
        F.col("base").alias("literal"), F.lit(None).cast("string").alias("name"),
        F.lit(False).alias("drop_blank"),
    )
    values = bases.unionByName(chain_values(found))
    known = values.join(table.select("bundle_id", "name", "value"), ["bundle_id", "name"], "left")
    text = F.coalesce("literal", "value")
    texts = known.withColumn("text", text).where(
        F.col("text").isNotNull() & (~F.col("drop_blank") | (F.trim("text") != ""))
    )
    # A chain lies inside one bundle, so its links are bounded by the bundle's text.
    links = F.array_sort(F.collect_list(F.struct("link_no", "branch", "text")))
    glued = texts.groupBy("bundle_id", "chain_no").agg(links.alias("links"))
    query = T.collapse_spaces(F.array_join(F.col("links.text"), ""))
    return glued.select("bundle_id", "chain_no", query.alias("query")).where(
        is_operation(F.col("query"))
    )


def script_captures(bundles: DataFrame) -> DataFrame:
    """Assembled operations and constants that are operations, repeats dropped.

    Repeats share the text and the name; the first one in text order is kept, chains before
    constants.  Columns: bundle_id, capture_no, query, name.
    """
    table = constants(bundles)
    from_chains = assembled(bundles, table).select(
        "bundle_id",
        F.lit(0).alias("stage"),
        F.struct(F.lit(0).alias("pass"), F.col("chain_no").alias("pos")).alias("at"),
        "query",
        first_match(F.col("query"), V.ASSEMBLED_NAME).alias("name"),
    )
    value = T.collapse_spaces(F.col("value"))
    from_constants = constant_kinds(table).select(
        "bundle_id",
        F.lit(1).alias("stage"),
        F.col("first_at").alias("at"),
        value.alias("query"),
        F.when(F.col("kind") == "operation", first_match(value, V.ASSEMBLED_NAME))
        .otherwise(first_match(value, V.INLINE_FRAGMENT))
        .alias("name"),
    )
    found = from_chains.unionByName(from_constants)
    at = F.struct("stage", "at")
    return (
        found.withColumn("name", F.coalesce("name", F.lit("")))
        .groupBy("bundle_id", F.sha2("query", 256).alias("text_id"), "name")
        .agg(F.min_by("query", at).alias("query"), F.min(at).alias("at"))
        .select("bundle_id", "at", "query", "name")
    )


def assembled_items(bundles: DataFrame, rank: int) -> DataFrame:
    """Captures as items; ``rank`` places them after all other extractors."""
    at = F.col("at")
    position = at["stage"] * 10 + at["at"]["pass"] + rank
    return script_captures(bundles).select(
        "bundle_id",
        F.lit("JS_EXECUTED").alias("source"),
        C.item_order(position, at["at"]["pos"]).alias("ord"),
        F.lit(C.PLAIN).alias("form"),
        F.col("query").alias("text"),
        "name",
        F.lit(None).cast("string").alias("hash"),
    )


def assembled_ops(bundles: DataFrame) -> DataFrame:
    """Operations of assembled texts, per bundle."""
    return C.classify(assembled_items(bundles, rank=100), C.REQUEST_FORMS)
