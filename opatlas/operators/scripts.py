"""Operations in script responses.

Servers send the same bundle over and over.  So every distinct text is read once
(:func:`distinct_bundles`), and what was found in it is joined back to the places and times
the bundle was seen at (:func:`sightings`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opatlas import fixed_values as V
from opatlas.functions import brackets as B
from opatlas.functions import classify as C
from opatlas.functions.columns import all_matches, contains_any, first_match, in_order, let
from opatlas.functions.patterns import BLOCK_LEVELS, balanced
from opatlas.session import materialize

# Operations are cut from their head to the brace that closes them; only the head is consumed, so
# operations inside of them are found as well.  (head, what it consumes from the opening brace on)
OPERATION_HEADS = {"raw": (V.OPERATION_HEAD, r"\{"), "compact": (V.COMPACT_HEAD, V.COMPACT_BLOCK)}
_BLOCK = balanced("{", "}", BLOCK_LEVELS)

# Extractors in the order their findings arrive: name -> (source, form, pattern, group).
PATTERN_EXTRACTORS = {
    "tagged": ("JS_FILE", C.TEMPLATE, V.TAGGED_TEMPLATE, 1),
    "raw": ("JS_FILE", C.REGION, V.OPERATION_HEAD, 0),
    "hash": ("JS_FILE", C.PERSISTED, V.JSON_SHA256_HASH, 1),
    "property": ("MINIFIED_JS", C.STRING, V.PROPERTY_STRING, 1),
    "quoted": ("MINIFIED_JS", C.QUOTED, V.QUOTED_OPERATION, 1),
    "compact": ("MINIFIED_JS", C.COMPACT, V.COMPACT_HEAD, 0),
    "query_field": ("MINIFIED_JS", C.STRING, V.QUERY_FIELD, 1),
    "body_field": ("MINIFIED_JS", C.STRING, V.BODY_FIELD, 1),
    "text_field": ("MINIFIED_JS", C.STRING, V.TEXT_FIELD, 1),
    "hex_id": ("MINIFIED_JS", C.PERSISTED, V.HEX_ID, 0),
    "node_name_first": ("MINIFIED_JS", C.DOC_ID, V.REQUEST_NODE_NAME_FIRST, 0),
    "node_id_first": ("MINIFIED_JS", C.DOC_ID, V.REQUEST_NODE_ID_FIRST, 0),
    "query_id": ("MINIFIED_JS", C.DOC_ID, V.SCRIPT_QUERY_ID, 0),
    "doc_id": ("MINIFIED_JS", C.DOC_ID, V.SCRIPT_DOC_ID, 0),
}
# Extractors that look at the text around their match, with the reach in characters.
CONTEXT = {
    "hex_id": V.HASH_CONTEXT_CHARS,
    "query_id": V.ID_CONTEXT_CHARS,
    "doc_id": V.ID_CONTEXT_CHARS,
}
# Text each pattern cannot match without; a substring test is far cheaper than a pattern.
_OPENING_WORDS = ['"query', '"mutation', '"subscription', '"fragment']
NEEDED_TEXT = {
    "tagged": ["gql", "graphql"],
    "hash": ['"sha256Hash"'],
    "property": [*_OPENING_WORDS, '"...'],
    "quoted": _OPENING_WORDS,
    "query_field": _OPENING_WORDS,
    "body_field": _OPENING_WORDS,
    "text_field": _OPENING_WORDS,
    "node_name_first": ['"Request"'],
    "node_id_first": ['"Request"'],
    "query_id": ["queryID", "queryId"],
    "doc_id": ["doc_id"],
}
_MATCH = "array<struct<text:string,before:string,after:string>>"


def bundle_id(body: Column) -> Column:
    return F.sha2(body, 256)


def sightings(scripts: DataFrame) -> DataFrame:
    """Where and when each distinct bundle was seen; the text itself stays behind.

    Written down, because it is read twice and reading it anew would hash all texts again.
    """
    at_urls = (
        scripts.select(bundle_id(F.col("body")).alias("bundle_id"), "url", "endpoint", "ts", "capture_id")
        .groupBy("bundle_id", "url", "endpoint")
        .agg(
            F.min(in_order(F.col("ts"), F.col("capture_id"))).alias("first_order"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            F.count("*").alias("n_seen"),
        )
    )
    # URLs of one endpoint differ by their query; only the first arrival's URL is ever shown.
    return materialize(
        at_urls.groupBy("bundle_id", "endpoint").agg(
            F.min_by("url", "first_order").alias("url"),
            F.min("first_order").alias("first_order"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.sum("n_seen").alias("n_seen"),
        )
    )


def distinct_bundles(scripts: DataFrame) -> DataFrame:
    """(bundle_id, body) with every distinct text once, whatever ids its captures have.

    ``scripts`` are admitted script responses, so other response bodies never reach the
    exchange.  Copies meet in their map task first; each distinct text of a task moves once.
    """
    return (
        scripts.select(bundle_id(F.col("body")).alias("bundle_id"), "body")
        .groupBy("bundle_id")
        .agg(F.first("body").alias("body"))
    )


def _matches(name: str, body: Column) -> Column:
    _, _, pattern, group = PATTERN_EXTRACTORS[name]
    if name in OPERATION_HEADS:
        head, consumed = OPERATION_HEADS[name]
        found = B.blocks_behind(body, head, consumed, _BLOCK)
    else:
        found = all_matches(body, pattern, group)
    nothing = F.array().cast("array<string>")
    if name in CONTEXT:
        # Text between matches: piece i stands before match i, piece i + 1 after it.
        found = let(
            found,
            lambda m: let(
                F.when(F.size(m) > 0, F.split(body, pattern, -1)).otherwise(nothing),
                lambda between: F.arrays_zip(
                    m, F.slice(between, F.lit(1), F.size(m)), F.slice(between, F.lit(2), F.size(m))
                ).cast(_MATCH),
            ),
        )
    else:
        found = F.arrays_zip(found, nothing, nothing).cast(_MATCH)
    if name not in NEEDED_TEXT:
        return found
    return F.when(contains_any(body, NEEDED_TEXT[name]), found)


def script_items(
    bundles: DataFrame, extractors: list[str] | None = None, keys: tuple[str, ...] = ("bundle_id",)
) -> DataFrame:
    """Items of every bundle; the text is read in one pass and dropped in the same step.

    ``keys`` are the columns that go with the items.
    """
    names = list(PATTERN_EXTRACTORS) if extractors is None else extractors
    ranks = {name: rank for rank, name in enumerate(PATTERN_EXTRACTORS)}
    body = F.col("body")
    per_extractor = bundles.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(ranks[n]).alias("rank"), _matches(n, body).alias("found")) for n in names])
        ).alias("extractor"),
    )
    found = per_extractor.select(
        *keys,
        F.col("extractor.rank").alias("rank"),
        F.posexplode("extractor.found").alias("match_no", "match"),
    )

    def by_name(values: dict[str, Column], default: Column) -> Column:
        picked = None
        for name, value in values.items():
            if name in names:
                test = F.col("rank") == ranks[name]
                picked = F.when(test, value) if picked is None else picked.when(test, value)
        return default if picked is None else picked.otherwise(default)

    def of_rank(values: list[str]) -> Column:
        return F.get(F.array(*[F.lit(value) for value in values]), F.col("rank"))

    text = F.col("match.text")
    reach = by_name({n: F.lit(r) for n, r in CONTEXT.items()}, F.lit(0))
    context = F.concat(
        F.right(F.col("match.before"), reach), F.left(F.concat(text, F.col("match.after")), reach)
    )
    found = found.select(
        *keys,
        "rank",
        C.item_order(F.col("rank"), F.col("match_no")).alias("ord"),
        text.alias("text"),
        context.alias("context"),
    )
    text, context = F.col("text"), F.col("context")
    nearby = F.coalesce(first_match(context, V.NEARBY_NAME), F.lit(V.ANONYMOUS))
    found = found.where(
        by_name({"hex_id": contains_any(context, V.HASH_CONTEXT_MARKS)}, F.lit(True))
    )
    found = found.withColumns(
        {
            "hash": by_name(
                {
                    "hash": text,
                    "hex_id": first_match(text, V.HEX_ID),
                    "node_name_first": first_match(text, V.REQUEST_NODE_NAME_FIRST, 2),
                    "node_id_first": first_match(text, V.REQUEST_NODE_ID_FIRST, 1),
                    "query_id": first_match(text, V.SCRIPT_QUERY_ID),
                    "doc_id": first_match(text, V.SCRIPT_DOC_ID),
                },
                F.lit(None).cast("string"),
            ),
            "name": by_name(
                {
                    "hex_id": first_match(context, V.JSON_OPERATION_NAME),
                    "node_name_first": first_match(text, V.REQUEST_NODE_NAME_FIRST, 1),
                    "node_id_first": first_match(text, V.REQUEST_NODE_ID_FIRST, 2),
                    "query_id": nearby,
                    "doc_id": nearby,
                },
                F.lit(None).cast("string"),
            ),
        }
    )
    found_id, name = F.col("hash"), F.col("name")

    def labelled(label: str) -> Column:
        return F.concat(F.lit(label), found_id, F.lit(" ("), name, F.lit(")"))

    snippet = by_name(
        {
            "hash": F.concat(F.lit("JS Persisted: "), found_id),
            "hex_id": F.concat(F.lit("Minified Persisted: "), found_id),
            "node_name_first": labelled("Relay doc_id: "),
            "node_id_first": labelled("Relay doc_id: "),
            "query_id": labelled("Meta queryID: "),
            "doc_id": labelled("Meta doc_id: "),
        },
        text,
    )
    return found.select(
        *keys,
        of_rank([source for source, _, _, _ in PATTERN_EXTRACTORS.values()]).alias("source"),
        "ord",
        of_rank([form for _, form, _, _ in PATTERN_EXTRACTORS.values()]).alias("form"),
        snippet.alias("text"),
        "name",
        "hash",
    )


def bundle_ops(bundles: DataFrame, extractors: list[str] | None = None) -> DataFrame:
    """Operations of every distinct bundle."""
    return C.classify(script_items(bundles, extractors))


def capture_items(scripts: DataFrame) -> DataFrame:
    """Items of every script response by itself, for streams, which don't wait for copies."""
    keys = ("capture_id", "ts", "url", "endpoint", "method")
    return script_items(scripts.withColumn("method", F.lit("GET")), keys=keys)


def at_sightings(ops: DataFrame, seen: DataFrame) -> DataFrame:
    """Operations of bundles at every place the bundle was seen at.

    A bundle seen at very many places makes one hot ``bundle_id`` on the sightings side
    only; the adaptive skew join splits that side and repeats the few operations.
    """
    return ops.join(seen, "bundle_id").withColumn("method", F.lit("GET"))


def bundle_inventory(scripts: DataFrame) -> DataFrame:
    """Distinct bundles, with how often they were served."""
    return (
        scripts.groupBy(bundle_id(F.col("body")).alias("bundle_id"))
        .agg(
            F.min("url").alias("url"),
            F.min("ts").alias("first_seen"),
            F.count("*").alias("n_served"),
            F.min(F.length("body")).cast("bigint").alias("n_chars"),
        )
    )
