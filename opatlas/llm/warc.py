"""WARC records: not-modified revisits resolved to the response they stand for.

A revisit of the profile "server not modified" has the headers of a 304 answer and no body.  It is
joined, by canonical URL, to the latest earlier full response (status 200, date not after the
revisit's; of equal dates the larger record id).  If a validator of both agrees (entity tags compared
without the weakness mark, else the modification dates), the revisit becomes that response with the
304's permitted headers put over the stored ones.

Each revisit has one outcome: ``resolved``; ``no_response`` (nothing earlier); ``no_validator`` (no
validator that both have); ``changed`` (their validator differs).  A record whose URL or date is null
or can't be read takes no part as a response and is ``no_response`` as a revisit.  Repeated records are
kept.  An empty table gives an empty result.

DataFrame expressions only.  A URL may hold any share of the records: they are sorted by URL and date
into ranges, each range knows its own latest response, and those before a range are carried in from a
table of one row for each URL and range.  Only record ids travel through windows, not bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opatlas.functions.columns import let
from opatlas.llm.tables import free_name, written

END = "\r\n"
RECORD_COLUMNS = ["record_id", "kind", "profile", "uri", "date", "status", "headers", "body"]
# The profile, and headers of a 304 that don't replace stored ones (RFC 9111, 3.2).
NOT_MODIFIED = "http://netpreserve.org/warc/1.0/revisit/server-not-modified"
NOT_MERGED = [
    "connection", "content-encoding", "content-length", "content-range", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection",
    "te", "trailer", "transfer-encoding", "upgrade",
]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(raw) records of WARC files, cut where a record ends and the next one begins."""
    raw = spark.read.text(path, lineSep=f"{END}{END}WARC/").withColumnRenamed("value", "raw")
    plain = F.regexp_replace("raw", r"^WARC/", "")
    return raw.select(F.concat(F.lit("WARC/"), plain).alias("raw")).where(F.trim(plain) != "")


def _headers(block: Column) -> Column:
    """(name in lower case, value) of the lines after a block's first."""
    lines = F.split(block, END)
    pairs = F.transform(
        F.filter(lines, lambda line, i: (i > 0) & line.contains(":")),
        lambda line: F.struct(
            F.lower(F.trim(F.substring_index(line, ":", 1))).alias("name"),
            F.trim(F.regexp_replace(line, r"^[^:]*:", "")).alias("value"),
        ),
    )
    return pairs


def header(headers: Column, name: str) -> Column:
    """Value of the first header of that name, null without one."""
    return F.try_element_at(F.filter(headers, lambda h: h["name"] == name), F.lit(1))["value"]


def parse(records: DataFrame, raw: str = "raw") -> DataFrame:
    """``RECORD_COLUMNS`` of raw records; what a record lacks is null."""

    def cut(text: Column) -> Column:
        head = F.substring_index(text, END * 2, 1)
        return F.struct(head.alias("head"), F.substring(text, F.length(head) + 5, F.length(text)).alias("rest"))

    parts = records.select(let(F.col(raw), cut).alias("outer"))
    parts = parts.select("outer.head", let(F.col("outer.rest"), cut).alias("http"))
    own = _headers(F.col("head"))
    return parts.select(own.alias("own"), "http").select(
        header(F.col("own"), "warc-record-id").alias("record_id"),
        header(F.col("own"), "warc-type").alias("kind"),
        header(F.col("own"), "warc-profile").alias("profile"),
        header(F.col("own"), "warc-target-uri").alias("uri"),
        F.try_to_timestamp(header(F.col("own"), "warc-date")).alias("date"),
        F.nullif(F.regexp_extract("http.head", r"^HTTP/\S+ ([0-9]{3})", 1), F.lit("")).cast("int").alias("status"),
        _headers(F.col("http.head")).alias("headers"),
        F.col("http.rest").alias("body"),
    )


def canonical_url(uri: Column) -> Column:
    """One spelling of a URL: no scheme, user, ``www.``, default port or fragment; host in lower
    case, an empty path as ``/``, query parameters sorted.  Null where there is no host."""
    part = r"^\s*(?i:(https?))://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    host = F.regexp_replace(
        F.regexp_replace(F.lower(F.regexp_extract(uri, part, 2)), r":(80|443)?$", ""), r"^www[0-9]*\.", ""
    )
    path = F.regexp_extract(uri, part, 3)
    path = F.when(path == "", "/").otherwise(path)
    query = F.array_join(F.sort_array(F.split(F.regexp_extract(uri, part, 4), "&")), "&")
    return F.when(host != "", F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(header(headers, "etag"), r"^W/", "")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, those of the 304 that may replace them put in their place; sorted."""
    allowed = F.filter(fresh, lambda h: ~h["name"].isin(NOT_MERGED))
    names = F.transform(allowed, lambda h: h["name"])
    return F.sort_array(F.concat(F.filter(stored, lambda h: ~F.array_contains(names, h["name"])), allowed))


def latest_before(events: DataFrame, key: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``events`` with the last non-null ``value`` of its key at or before each row, in ``order``.

    Rows are cut into ranges of the whole order, so a key may be spread over many tasks.
    """
    place = free_name(events, "range_number")
    ranged = events.repartitionByRange(*key, *order).withColumn(place, F.spark_partition_id())
    ranged = written(ranged, "ranges")  # the ranges are fixed from here on
    last = ranged.where(F.col(value).isNotNull()).groupBy(*key, place).agg(
        F.max_by(F.col(value), F.struct(*order)).alias("own_last")
    )
    keys = ranged.select(*key, place).distinct().join(last, [*key, place], "left")
    before = Window.partitionBy(*key).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    carried = keys.select(
        *[F.col(k).alias(f"of_{k}") for k in key],
        F.col(place).alias("of_range"),
        F.last("own_last", ignorenulls=True).over(before).alias("carried"),
    )
    within = Window.partitionBy(*key, place).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumn(out, F.last(value, ignorenulls=True).over(within))
    same = F.col(place) == F.col("of_range")
    for k in key:
        same &= F.col(k) == F.col(f"of_{k}")
    joined = own.join(carried.where("carried is not null"), same, "left")
    return joined.withColumn(out, F.coalesce(out, "carried")).drop(
        place, "carried", "of_range", *[f"of_{k}" for k in key]
    )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """A row for each not-modified revisit: record_id, uri, date, outcome, response_id, and of the
    resolved ones the response's ``body`` and the merged ``headers``."""
    base = records.select(*RECORD_COLUMNS).withColumn("url", canonical_url(F.col("uri")))
    is_response = (F.col("kind") == "response") & (F.col("status") == 200)
    is_revisit = (F.col("kind") == "revisit") & (F.col("profile") == NOT_MODIFIED)
    events = base.where((is_response | is_revisit) & F.col("url").isNotNull() & F.col("date").isNotNull())
    # of one date, responses come first; then by id, so that the largest is the latest
    events = events.select(
        "url", "date", "record_id",
        F.when(is_revisit, 1).otherwise(0).alias("turn"),
        F.when(is_response, F.col("record_id")).alias("own_response"),
    )
    found = latest_before(events, ["url"], ["date", "turn", "record_id"], "own_response", "response_id")
    # at most one response for a revisit, whose record may be repeated
    of_revisit = found.where("turn = 1").select(
        F.col("record_id").alias("asked"), F.col("url").alias("asked_url"), F.col("date").alias("asked_date"), "response_id"
    ).dropDuplicates(["asked", "asked_url", "asked_date"])
    revisits = base.where(is_revisit).join(
        of_revisit,
        F.col("record_id").eqNullSafe(F.col("asked"))
        & (F.col("url") == F.col("asked_url"))
        & (F.col("date") == F.col("asked_date")),
        "left",
    )
    responses = base.where(is_response & F.col("url").isNotNull() & F.col("date").isNotNull()).select(
        F.col("record_id").alias("of_response"), F.col("headers").alias("stored"), F.col("body").alias("full_body")
    )
    responses = responses.dropDuplicates(["of_response"])
    pairs = revisits.join(responses, F.col("response_id") == F.col("of_response"), "left")
    fresh_tag, stored_tag = _tag(F.col("headers")), _tag(F.col("stored"))
    fresh_date = header(F.col("headers"), "last-modified")
    stored_date = header(F.col("stored"), "last-modified")
    agrees = F.coalesce(fresh_tag == stored_tag, fresh_date == stored_date)
    outcome = (
        F.when(F.col("of_response").isNull(), "no_response")
        .when(agrees.isNull(), "no_validator")
        .when(agrees, "resolved")
        .otherwise("changed")
    )
    resolved = F.col("outcome") == "resolved"
    return pairs.withColumn("outcome", outcome).select(
        "record_id",
        "uri",
        "date",
        "outcome",
        "response_id",
        F.when(resolved, merged_headers(F.col("stored"), F.col("headers"))).alias("headers"),
        F.when(resolved, F.col("full_body")).alias("body"),
    )


def crawl_of_pages(pages: DataFrame) -> DataFrame:
    """(raw) a crawl made from ``pages``: each page's full response, for every fourth a newer one,
    a revisit of each page, and for every third one of a home page that all share."""
    page = F.coalesce(F.col("page_id"), F.lit(0))
    html = F.coalesce(F.col("html"), F.lit(""))
    url = F.coalesce(F.col("url"), F.lit(""))
    newer = F.concat(html, F.lit("<!-- newer -->"))
    tag = F.concat(F.lit('"'), F.md5(html.cast("binary")), F.lit('"'))

    def text(*parts: Column | str) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    def record(kind: str, number: int, uri: Column, second: Column, http: Column, body: Column) -> Column:
        date = F.date_format(F.timestamp_seconds(F.lit(1704067200) + second), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        name = F.lpad((page * 4 + number).cast("string"), 20, "0")
        profile = f"WARC-Profile: {NOT_MODIFIED}{END}" if kind == "revisit" else ""
        return text(
            f"WARC/1.0{END}WARC-Type: {kind}{END}WARC-Target-URI: ", uri, f"{END}WARC-Date: ", date,
            f"{END}WARC-Record-ID: <urn:record:", name, f">{END}", profile, f"Content-Length: ",
            (F.octet_length(http) + F.octet_length(body)).cast("string"), END * 2, http, body,
        )

    def full(tag: Column, modified: Column, length: Column) -> Column:
        return text(
            f"HTTP/1.1 200 OK{END}Content-Type: text/html{END}ETag: ", tag, f"{END}Last-Modified: ", modified,
            f"{END}Content-Length: ", length.cast("string"), f"{END}Cache-Control: max-age=60{END}X-Served: a{END}{END}",
        )

    def same(validators: Column) -> Column:
        return text(
            f"HTTP/1.1 304 Not Modified{END}", validators,
            f"Cache-Control: max-age=120{END}Content-Length: 0{END}Connection: close{END}Age: 5{END}{END}",
        )

    modified = text("day ", page.cast("string"))
    validators = (
        F.when(page % 6 == 0, text("ETag: ", tag, END))
        .when(page % 6 == 1, text("ETag: W/", tag, END))
        .when(page % 6 == 2, text('ETag: "other"', END))
        .when(page % 6 == 3, text("Last-Modified: ", modified, END))
        .otherwise(F.when(page % 6 == 4, F.lit("")).otherwise(text("ETag: ", tag, END)))
    )
    when = page * 60
    again = F.when(page % 6 == 5, when - 30).otherwise(when + 3600)
    other_spelling = F.when(page % 2 == 0, F.concat(url, F.lit("#part"))).otherwise(url)
    home, home_tag = F.lit("https://Home.example.com"), text('"home ', F.floor(page / 300).cast("string"), '"')
    none = F.lit(None).cast("string")
    empty = F.lit("")
    return pages.select(
        F.explode(
            F.array(
                record("response", 0, url, when, full(tag, modified, F.octet_length(html)), html),
                F.when(
                    page % 4 == 0,
                    record("response", 1, url, when + 1800, full(F.lit('"new"'), modified, F.octet_length(newer)), newer),
                ).otherwise(none),
                record("revisit", 2, other_spelling, again, same(validators), empty),
                F.when(
                    page % 300 == 0,
                    record("response", 3, F.lit("http://home.example.com:80/"), when, full(home_tag, modified, F.lit(4)), F.lit("home")),
                )
                .when(page % 3 == 0, record("revisit", 3, home, when, same(text("ETag: ", home_tag, END)), empty))
                .otherwise(none),
            )
        ).alias("raw")
    ).where("raw is not null")


def revisit_digest(pages: DataFrame) -> DataFrame:
    """One row for each revisit of the crawl: outcome, response, merged headers, checksum of the body."""
    records = written(parse(crawl_of_pages(pages)), "records")
    lines = F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"]))
    return resolve_revisits(records).select(
        "record_id",
        "uri",
        "outcome",
        "response_id",
        F.array_join(lines, "\n").alias("merged_headers"),
        F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"),
    )
