"""Classification of operation text: which operations does it hold?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opatlas import fixed_values as V
from opatlas.functions import text as T
from opatlas.functions.columns import all_matches, first_match, let

# Forms an extracted item can have, i.e. what its text is and how it has to be read.
JSON = "json"            # JSON string content
PLAIN = "plain"          # operation text as it is
TEMPLATE = "template"    # script template content
REGION = "region"        # script text from an operation head to the brace that closes it
STRING = "string"        # script string content
QUOTED = "quoted"        # script string content with an operation head
COMPACT = "compact"      # the same from a compact operation head on
PERSISTED = "persisted"  # a hash; text is the display snippet
DOC_ID = "doc_id"        # an id; text is the display snippet

REQUEST_FORMS = [JSON, PLAIN, PERSISTED, DOC_ID]
ALL_FORMS = [*REQUEST_FORMS, TEMPLATE, REGION, STRING, QUOTED, COMPACT]
_SCRIPT_FORMS = [TEMPLATE, REGION, STRING, QUOTED, COMPACT]

_OPERATIONS = "array<struct<operation_type:string,operation_name:string,operation_body:string>>"


def _one(operation_type: Column, operation_name: Column, body: Column) -> Column:
    return F.array(F.struct(operation_type, operation_name, body)).cast(_OPERATIONS)


def operations_in(text: Column, fallback: Column) -> Column:
    """Operations in one document: an array, null when the text is none.

    Named operations and fragment definitions come first.  Only without them an unnamed
    operation, an inline fragment or a bare selection counts, in this order.
    """

    def read(body: Column) -> Column:
        # The text is collapsed, so a match reads "query Name(" and its words are its parts.
        words = F.transform(
            all_matches(body, V.NAMED_OPERATION),
            lambda match: F.split(match, V.OPERATION_WORD_END),
        )
        named = F.transform(words, lambda w: F.struct(F.get(w, 0), F.get(w, 1), body)).cast(_OPERATIONS)
        fragments = F.transform(
            all_matches(body, V.FRAGMENT_DEFINITION, 1),
            lambda name: F.struct(F.lit("fragment"), name, body),
        ).cast(_OPERATIONS)
        declared = F.when(body.contains("fragment "), F.concat(named, fragments)).otherwise(named)
        inline = first_match(body, V.INLINE_FRAGMENT)
        selection = (
            body.contains("{")
            & body.contains("}")
            & (body.contains(V.TYPENAME_MARK) | body.rlike(V.SELECTION_LIKE))
        )
        undeclared = (
            F.when(
                body.rlike(V.ANONYMOUS_OPERATION),
                _one(F.regexp_extract(body, V.ANONYMOUS_OPERATION, 1), fallback, body),
            )
            .when(body.startswith("...") & inline.isNotNull(), _one(F.lit("fragment"), inline, body))
            .when(selection, _one(F.lit("query"), fallback, body))
        )
        return let(declared, lambda found: F.when(F.size(found) > 0, found).otherwise(undeclared))

    return let(T.collapse_spaces(T.drop_comments(text)), read)


def _operations(forms: list[str], form: Column, text: Column, fallback: Column) -> Column:
    """Operations of one item.  The text is prepared, cleaned and read in three bound steps."""
    present = set(forms)

    def choose(branches: list[tuple[list[str], Column]], default: Column) -> Column:
        chosen = None
        for names, value in branches:
            names = [n for n in names if n in present]
            if names:
                test = form.isin(*names)
                chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
        return default if chosen is None else chosen.otherwise(default)

    def read(prepared: Column, cleaned: Column) -> Column:
        compact = _one(
            F.regexp_extract(prepared, V.COMPACT_TYPE_AND_NAME, 1),
            F.regexp_extract(prepared, V.COMPACT_TYPE_AND_NAME, 2),
            cleaned,
        )
        return choose(
            [([PERSISTED, DOC_ID], _one(form, fallback, prepared)), ([COMPACT], compact)],
            operations_in(cleaned, fallback),
        )

    prepared = choose(
        [
            ([JSON], T.unescape_json(text)),
            ([STRING, QUOTED], T.unescape_script(text)),
        ],
        text,
    )
    scripts = [f for f in _SCRIPT_FORMS if f in present]
    if not scripts:
        return let(prepared, lambda p: read(p, p))
    return let(
        prepared,
        lambda p: let(choose([(scripts, T.clean_script_text(p))], p), lambda c: read(p, c)),
    )


def classify(items: DataFrame, forms: list[str] = ALL_FORMS) -> DataFrame:
    """One row per operation.

    Reads ``form``, ``text``, ``name`` (fallback name), ``hash`` and ``ord`` of every item
    and replaces them by ``operation_type``, ``operation_name``, ``persisted_hash``,
    ``operation_body`` and the operation's ``ord``.  All other columns are kept.  ``forms``
    are the forms that can occur; the others cost nothing then.
    """
    kept = [c for c in items.columns if c not in ("form", "text", "name", "hash", "ord")]
    fallback = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit(V.ANONYMOUS))
    found = _operations(forms, F.col("form"), F.col("text"), fallback)
    ops = items.select(*kept, "ord", "hash", F.posexplode(found).alias("op_no", "op"))
    return ops.select(
        *kept,
        (F.col("ord") + F.col("op_no")).alias("ord"),
        F.col("op.operation_type").alias("operation_type"),
        F.col("op.operation_name").alias("operation_name"),
        F.col("hash").alias("persisted_hash"),
        F.col("op.operation_body").alias("operation_body"),
    )


def item_order(outer: Column, inner: Column) -> Column:
    """Position of an item in its capture; leaves room for the operations inside the item."""
    return outer.cast("bigint") * 10**12 + inner.cast("bigint") * 10**6
