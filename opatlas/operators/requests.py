"""Operations in HTTP requests and socket messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opatlas import fixed_values as V
from opatlas.functions import classify as C
from opatlas.functions.columns import all_matches, let
from opatlas.operators import gates

_ID_KEYS = {"doc_id": V.JSON_DOC_ID, "queryId": V.JSON_QUERY_ID, "document_id": V.JSON_DOCUMENT_ID}
_ITEMS = "array<struct<form:string,text:string,name:string,hash:string>>"
_PLACES = "array<struct<ord:bigint,form:string,text:string,name:string,hash:string>>"


def _every(text: Column, mark: str, pattern: str) -> Column:
    """All matches; a cheap substring test goes first."""
    return F.when(text.contains(mark), all_matches(text, pattern, 1)).otherwise(_nothing())


def _nothing() -> Column:
    return F.array().cast("array<string>")


def _name(text: Column) -> Column:
    """The first operation name in a text, '' for none."""
    return F.when(text.contains('"operationName"'), F.regexp_extract(text, V.JSON_OPERATION_NAME, 1)).otherwise("")


def _ids(form: str, label: str, ids: Column, name: Column, suffix: Column | str = "") -> Column:
    """One item per hash or id; its text is what users see of it."""
    tail = F.lit(suffix) if isinstance(suffix, str) else suffix
    return F.transform(
        ids, lambda x: F.struct(F.lit(form), F.concat(F.lit(label), x, tail), name, x)
    ).cast(_ITEMS)


def _texts(form: str, texts: Column, name: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(F.lit(form), t, name, F.lit(None))).cast(_ITEMS)


def _decoded(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), value)


def _items_of_part(part: Column) -> Column:
    """Hashes, ids and texts of one part of a body, in this order, with the part's name."""

    def named(name: Column) -> Column:
        suffix = F.when(name == "", "").otherwise(F.concat(F.lit(" ("), name, F.lit(")")))
        sha256 = _every(part, '"sha256Hash"', V.JSON_SHA256_HASH)
        plain = _every(part, '"hash"', V.JSON_HASH)
        return F.concat(
            let(sha256, lambda found: _ids(C.PERSISTED, "Persisted: ", F.when(F.size(found) > 0, found).otherwise(plain), name)),
            *[
                _ids(C.DOC_ID, f"{key}: ", _every(part, f'"{key}"', pattern), name, suffix)
                for key, pattern in _ID_KEYS.items()
            ],
            _texts(C.JSON, _every(part, '"query"', V.JSON_QUERY), name),
        )

    return let(_name(part), named)


def _items_of_url(url: Column) -> Column:
    """Hashes and texts of a URL's parameters."""
    extensions = F.transform(all_matches(url, V.URL_EXTENSIONS, 1), _decoded)
    hashes = F.flatten(F.transform(extensions, lambda e: all_matches(e, V.DECODED_HASH, 1)))
    texts = F.transform(all_matches(url, V.URL_QUERY, 1), _decoded)
    none = F.lit("")
    return F.concat(_ids(C.PERSISTED, "Persisted GET: ", hashes, none), _texts(C.PLAIN, texts, none))


def body_parts(body: Column) -> Column:
    """The parts of a batched body, the body itself of any other.

    A batch is read as JSON.  One that isn't JSON is cut where a comma stands between a closing
    and an opening brace outside of strings.
    """
    parsed = F.from_json(body, "array<string>")
    return F.when(
        body.rlike(V.BATCH_START), F.coalesce(F.filter(parsed, lambda p: p.isNotNull()), all_matches(body, V.BATCH_PART))
    ).otherwise(F.array(body))


def _placed(items: Column, part_no: Column) -> Column:
    return F.transform(
        items,
        lambda item, i: F.struct(C.item_order(part_no, i), item["form"], item["text"], item["name"], item["hash"]),
    ).cast(_PLACES)


def _read_once(captures: DataFrame, items: Column) -> DataFrame:
    """``captures`` with their ``items`` behind a generator.

    A test of the items would be pushed below a plain column and read every text a second time.
    """
    return captures.select("*", F.explode(F.array(items)).alias("items"))


def http_exchange_items(exchanges: DataFrame, keep_empty: bool = False) -> DataFrame:
    """All items of each request body or URL, as one array per exchange; one scan.

    An exchange that passes the gates without holding an item is dropped unless ``keep_empty``.
    """
    body = F.col("req_body")
    of_body = F.flatten(F.transform(body_parts(body), lambda part, i: _placed(_items_of_part(part), i)))
    of_url = _placed(_items_of_url(F.col("url")), F.lit(0))
    found = _read_once(
        exchanges.where((gates.is_post() & gates.body_gate()) | (gates.is_get() & gates.url_gate())),
        F.when(gates.is_get(), of_url).otherwise(of_body),
    ).select("capture_id", "ts", "host", "url", F.col("path").alias("endpoint"), "method", "items")
    return found if keep_empty else found.where(F.size("items") > 0)


def socket_message_items(messages: DataFrame) -> DataFrame:
    """All items of each text message from client to server, as one array per message."""
    payload = F.col("payload")

    def named(name: Column) -> Column:
        return F.concat(
            _texts(C.JSON, _every(payload, '"query"', V.JSON_QUERY), name),
            _ids(C.PERSISTED, "WS Persisted: ", _every(payload, '"sha256Hash"', V.JSON_SHA256_HASH), name),
        )

    found = _read_once(
        messages.where(gates.socket_gate()), _placed(let(_name(payload), named), F.lit(0))
    ).select(
        "capture_id",
        "ts",
        F.lit(None).cast("string").alias("host"),
        "url",
        F.col("path").alias("endpoint"),
        F.lit("WS").alias("method"),
        "items",
    )
    return found.where(F.size("items") > 0)


def exploded(found: DataFrame) -> DataFrame:
    """One row per item; columns beside the items are kept."""
    kept = [c for c in found.columns if c != "items"]
    item = F.col("item")
    source = (
        F.when(F.col("method") == "WS", "WEBSOCKET")
        .when(item["hash"].isNotNull(), "PERSISTED_QUERY")
        .otherwise("HTTP_POST")
    )
    return found.select(*kept, F.explode("items").alias("item")).select(
        *kept, source.alias("source"), "item.ord", "item.form", "item.text", "item.name", "item.hash"
    )


def http_items(exchanges: DataFrame) -> DataFrame:
    """Items found in request bodies and URLs, one row each."""
    return exploded(http_exchange_items(exchanges))


def socket_items(messages: DataFrame) -> DataFrame:
    """Items found in text messages from client to server, one row each."""
    return exploded(socket_message_items(messages))


def http_ops(exchanges: DataFrame) -> DataFrame:
    """One row per operation and capture."""
    return C.classify(http_items(exchanges), C.REQUEST_FORMS)


def socket_ops(messages: DataFrame) -> DataFrame:
    return C.classify(socket_items(messages), C.REQUEST_FORMS)
