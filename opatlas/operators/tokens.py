"""Operation texts as token tables: depth, fields and arguments.

Every distinct text is tokenised once.  Texts are dealt by ``op_id`` before they are cut into
tokens, so texts move, not their tokens; depths, neighbours, roles and owners are windows over one
text on that partitioning.  A window partition is a single operation text and cannot grow with the
traffic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opatlas import fixed_values as V
from opatlas.functions.columns import all_matches, let
from opatlas.operators.variables import with_text

ROOT_MARK = "{"      # owner of a definition's outermost block
SKIPPED_MARK = ""    # owner of an inline fragment's block

SEEN = ["first_order", "first_ord"]


def distinct_bodies(found: DataFrame) -> DataFrame:
    """Distinct operation texts with their first arrival: (op_id, body, first_order, first_ord)."""
    return (
        with_text(found)
        .groupBy(F.col("operation_body").alias("body"))
        .agg(F.min(F.struct("first_order", "first_ord")).alias("seen"))
        .select(F.sha2("body", 256).alias("op_id"), "body", "seen.first_order", "seen.first_ord")
    )


def tokens(bodies: DataFrame, keys: tuple[str, ...] = ("op_id",)) -> DataFrame:
    """One row per token with its place in the structure; ``keys`` are the columns that go with it.

    paren, nest   depth in parentheses, and in all brackets inside of them
    depth         depth in selection braces, the token included
    def_no        number of the definition the token belongs to
    """
    token = F.col("token")
    order = Window.partitionBy("op_id").orderBy("pos")
    through = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    def step(opens: list[str], closes: list[str]) -> Column:
        return F.when(token.isin(opens), 1).when(token.isin(closes), -1).otherwise(0)

    dealt = bodies.select(*keys, "body").repartition("op_id")
    df = dealt.select(*keys, F.posexplode(all_matches(F.col("body"), V.TOKEN)).alias("pos", "token"))
    df = df.select(
        "*",
        F.sum(step(["("], [")"])).over(through).alias("paren"),
        F.lag("token", 1).over(order).alias("prev1"),
        F.lag("token", 2).over(order).alias("prev2"),
        F.lead("token", 1).over(order).alias("next1"),
        F.lead("token", 2).over(order).alias("next2"),
    )
    df = df.withColumn("in_paren", (F.col("paren") > 0) | (token == ")"))
    df = df.withColumns(
        {
            "depth": F.sum(F.when(~F.col("in_paren"), step(["{"], ["}"])).otherwise(0)).over(through),
            "nest": F.sum(
                F.when(F.col("in_paren"), step(["(", "[", "{"], [")", "]", "}"])).otherwise(0)
            ).over(through),
        }
    )
    ends = (token == "}") & ~F.col("in_paren") & (F.col("depth") == 0)
    group = F.when(
        (token == "(") & (F.col("nest") == 1), F.when(F.col("prev2") == "@", "directive").otherwise("arguments")
    )
    return df.withColumns(
        {
            "def_no": F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(before), F.lit(0)),
            "group": F.last(group, ignorenulls=True).over(through),
        }
    )


def with_roles(df: DataFrame) -> DataFrame:
    """Tokens with a ``role``: header, field, spread, open, close, argument, or null."""
    token, prev1, prev2 = F.col("token"), F.col("prev1"), F.col("prev2")
    is_name = token.rlike("^[A-Za-z_]")
    outside = ~F.col("in_paren")
    follows_spread = F.coalesce(prev1.isin("@", "...") | ((prev1 == "on") & (prev2 == "...")), F.lit(False))
    before_colon = F.coalesce(F.col("next1") == ":", F.lit(False))
    role = (
        F.when(outside & (token == "{"), "open")
        .when(outside & (token == "}"), "close")
        .when(outside & (F.col("depth") < 1) & (is_name | (token == "...")), "header")
        .when(outside & (token == "..."), "spread")
        .when(outside & is_name & ~follows_spread & ~before_colon, "field")
        .when(
            ~outside & is_name & before_colon & (F.col("nest") == 1)
            & (F.col("depth") >= 1) & (F.col("group") == "arguments"),
            "argument",
        )
    )
    return df.withColumn("role", role)


def structure_report(found: DataFrame) -> DataFrame:
    """Size and depth of every distinct operation text."""
    df = with_roles(tokens(distinct_bodies(found)))
    return df.groupBy("op_id").agg(
        F.count("*").alias("n_tokens"),
        F.max("depth").cast("bigint").alias("max_depth"),
        F.max_by("depth", "pos").cast("bigint").alias("closing_depth"),
        F.count_if(F.col("role") == "field").alias("n_fields"),
        F.count_if(F.col("role") == "argument").alias("n_arguments"),
        F.count_if((F.col("role") == "open") & (F.col("depth") == 1)).alias("n_definitions"),
    )


def with_owners(df: DataFrame) -> DataFrame:
    """Tokens that have a role, with the field (or inline fragment) whose block they stand in.

    number       counts the tokens of a definition from 0
    owner        number of the field or spread that opened the innermost block; null at the root
    owner_pos    its position; at the root, that of the definition's opening brace
    last_name    the field or spread before the token, which arguments belong to

    A block belongs to the mark in front of its brace, and a token to the last block opened on its own
    depth, so pointers to owners come from two windows and no state is carried along the text.
    """
    order = Window.partitionBy("op_id", "def_no").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("role") == "field", F.col("token")).when(F.col("role") == "spread", SKIPPED_MARK)
    df = df.where("role is not null").withColumn("number", F.row_number().over(order) - 1)
    df = df.withColumns(
        {
            "last_mark": F.last(F.when(mark.isNotNull(), F.col("number")), ignorenulls=True).over(before),
            "last_pos": F.last(F.when(mark.isNotNull(), F.col("pos")), ignorenulls=True).over(before),
            "last_name": F.last(mark, ignorenulls=True).over(before),
        }
    )
    is_open, is_root = F.col("role") == "open", F.col("depth") == 1
    level = Window.partitionBy("op_id", "def_no", "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.last(
        F.when(
            is_open,
            F.struct(
                F.when(~is_root, F.col("last_mark")).alias("number"),
                F.when(is_root, F.col("pos")).otherwise(F.col("last_pos")).alias("pos"),
            ),
        ),
        ignorenulls=True,
    ).over(level)
    return df.withColumn("opened", opened).withColumns(
        {"owner": F.col("opened.number"), "owner_pos": F.col("opened.pos")}
    )


def _with_paths(events: Column) -> Column:
    """Fields and arguments with the names of their owners, outermost first.

    Each event follows its own chain of owners through the array, so the work is that of writing the
    paths down and fields of one block cost the same however many there are.
    """

    def path(own: Column, event: Column) -> Column:
        start = F.struct(event["owner"].alias("at"), F.array().cast("array<string>").alias("names"))

        def up(state: Column, _: Column) -> Column:
            owner = F.get(own, state["at"])
            name = F.when(owner["kind"] == "spread", SKIPPED_MARK).otherwise(owner["name"])
            return F.when(
                state["at"].isNotNull(),
                F.struct(owner["owner"].alias("at"), F.concat(state["names"], F.array(name)).alias("names")),
            ).otherwise(state)

        # a token at depth d stands in d - 1 owners; a spread is one, too
        steps = F.sequence(F.lit(2), F.greatest(event["depth"], F.lit(2)))
        return F.aggregate(steps, start, up, lambda state: F.reverse(state["names"]))

    def one(own: Column, event: Column) -> Column:
        is_argument = event["kind"] == "argument"
        return F.struct(
            event["kind"].alias("kind"), event["pos"].alias("pos"), path(own, event).alias("path"),
            event["owner_pos"].alias("owner_pos"),
            F.when(is_argument, event["last_name"]).otherwise(event["name"]).alias("name"),
            F.when(is_argument, event["name"]).otherwise(event["alias"]).alias("alias"), event["value"].alias("value"),
        )

    return let(
        events,
        lambda own: F.transform(F.filter(own, lambda e: e["kind"].isin("field", "argument")), lambda e: one(own, e)),
    )


def selections(bodies: DataFrame) -> DataFrame:
    """Fields and arguments of all definitions.

    op_id, first_order, first_ord        the operation text and its first arrival
    def_type, def_name, on_type          the definition; on_type for fragments only
    kind                                 field or argument
    path                                 names of the fields around it, outermost first
    owner_pos                            position of the innermost of them
    name, alias                          of a field; for an argument, its field and its own name
    value                                first token of an argument's value

    Everything inside inline fragments is left out, as are meta fields (``__``) and what is
    below them, except that ``is_meta`` rows remain to show that their parent has children.
    """
    df = with_owners(with_roles(tokens(bodies, ("op_id", *SEEN))))
    aliased = (F.col("role") == "field") & (F.col("prev1") == ":")
    event = F.struct(
        "number",
        "pos",
        F.col("role").alias("kind"),
        F.col("token").alias("name"),
        F.when(aliased, F.col("prev2")).alias("alias"),
        F.when(F.col("role") == "argument", F.col("next2")).alias("value"),
        F.col("depth").cast("int").alias("depth"),
        "owner",
        "owner_pos",
        "last_name",
    )
    # One definition is part of one operation text; hash partitioning on op_id serves this too.
    definitions = df.groupBy("op_id", "def_no", *SEEN).agg(
        F.array_sort(F.collect_list(event)).alias("events"), F.min("pos").alias("def_pos")
    )
    is_header = F.filter("events", lambda e: e["kind"] == "header")
    definitions = definitions.select(
        "op_id", *SEEN, "def_pos", "events", F.transform(is_header, lambda e: e["name"]).alias("header")
    )
    header = F.col("header")
    word = F.get(header, 0)
    root_of_type = F.create_map(*[F.lit(x) for word_, type_ in V.ROOT_TYPES.items() for x in (type_, word_)])
    on_type = F.when(word == "fragment", F.get(header, 3)).when(word == "...", F.get(header, 2))
    definitions = definitions.select(
        "op_id",
        *SEEN,
        "def_pos",
        F.when(word.isin(list(V.ROOT_TYPES)), word).when(on_type.isNull(), "query")
        .otherwise(F.coalesce(F.try_element_at(root_of_type, on_type), F.lit("fragment")))
        .alias("def_type"),
        F.coalesce(F.when(word.isin(V.DEFINITION_WORDS), F.get(header, 1)), F.lit("")).alias("def_name"),
        on_type.alias("on_type"),
        F.explode(_with_paths(F.col("events"))).alias("o"),
    )
    rows = definitions.select(
        "op_id", *SEEN, "def_type", "def_name", "on_type", "o.kind", "o.pos", "o.path",
        F.coalesce("o.owner_pos", "def_pos").alias("owner_pos"),
        "o.name", "o.alias", "o.value",
    )
    inside_skipped = F.exists("path", lambda n: (n == SKIPPED_MARK) | n.startswith("__"))
    return rows.where(~inside_skipped & (F.col("name") != SKIPPED_MARK)).withColumn(
        "is_meta", F.col("name").startswith("__")
    )
