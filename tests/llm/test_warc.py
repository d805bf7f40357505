from __future__ import annotations

import pytest

pytest.importorskip("opatlas.llm")
from opatlas.llm import warc  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

PAGES = "page_id bigint, url string, html string"


def plain(records):
    """Outcome of every revisit, by looking through all responses."""
    out = []
    for r in records:
        if r["kind"] != "revisit" or r["profile"] != warc.NOT_MODIFIED:
            continue
        earlier = [
            s for s in records
            if s["kind"] == "response" and s["status"] == 200 and s["url"] and s["url"] == r["url"]
            and s["date"] and r["date"] and s["date"] <= r["date"]
        ]
        if not earlier:
            out.append((r["record_id"], "no_response", None, None, None))
            continue
        found = max(earlier, key=lambda s: (s["date"], s["record_id"]))
        fresh, stored = ([(h["name"], h["value"]) for h in x["headers"]] for x in (r, found))
        first = lambda hs, n: next((v for k, v in hs if k == n), None)
        tags = [t and t.removeprefix("W/") for t in (first(fresh, "etag"), first(stored, "etag"))]
        dates = [first(fresh, "last-modified"), first(stored, "last-modified")]
        agrees = tags[0] == tags[1] if None not in tags else dates[0] == dates[1] if None not in dates else None
        outcome = {None: "no_validator", True: "resolved", False: "changed"}[agrees]
        headers = body = None
        if agrees:
            allowed = [h for h in fresh if h[0] not in warc.NOT_MERGED]
            names = {k for k, _ in allowed}
            headers = tuple(sorted([h for h in stored if h[0] not in names] + allowed))
            body = found["body"]
        out.append((r["record_id"], outcome, found["record_id"], headers, body))
    return sorted(out, key=str)


def check(spark, raw):
    records = warc.parse(raw)
    known = [r.asDict(recursive=True) for r in records.withColumn("url", warc.canonical_url(F.col("uri"))).collect()]
    got = [
        (r.record_id, r.outcome, r.response_id, r.headers and tuple((h.name, h.value) for h in r.headers), r.body)
        for r in warc.resolve_revisits(records).collect()
    ]
    assert sorted(got, key=str) == plain(known)
    return got


def pages(n):
    rows = [(i, f"https://www.site{i % 7}.example.com/p/{i % 11}?b=2&a=1", f"<p>{i % 5}</p>") for i in range(n)]
    return [*rows, (None, None, None), (n, "no url", ""), (n + 1, "", None), rows[3], rows[3]]


def test_crawl_of_pages_equals_a_plain_version(spark):
    frame = spark.createDataFrame(pages(700), PAGES).selectExpr("*", "1 as record_id", "2 as headers").repartition(3)
    outcomes = {o for _, o, *_ in check(spark, warc.crawl_of_pages(frame))}
    assert outcomes == {"resolved", "no_response", "no_validator", "changed"}


def record(kind, name, uri, date, http):
    profile = f"WARC-Profile: {warc.NOT_MODIFIED}\r\n" if kind == "revisit" else ""
    return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nWARC-Date: {date}\r\n{profile}"
            f"WARC-Record-ID: {name}\r\nContent-Length: {len(http)}\r\n\r\n{http}")


FULL = 'HTTP/1.1 200 OK\r\nETag: "1"\r\nETag: "2"\r\nContent-Encoding: gzip\r\nX: old\r\n\r\nbody\r\n\r\nmore'
SAME = 'HTTP/1.1 304 Not Modified\r\nETag: W/"1"\r\nContent-Encoding: br\r\nX: new\r\n\r\n'


def test_odd_records(spark):
    raw = [
        record("response", "a", "http://h.test:80/x#1", "2024-01-01T00:00:00Z", FULL),
        record("response", "b", "http://h.test/x", "2024-01-01T00:00:00Z", FULL.replace("more", "later id")),
        record("response", "c", "http://h.test/x", "2024-01-01T00:00:05Z", FULL.replace("200", "404")),
        record("revisit", "d", "https://WWW.h.test:443/x", "2024-01-01T00:00:09Z", SAME),
        record("revisit", "e", "https://h.test/x", "not a date", SAME),
        record("revisit", "f", "https://h.test/x", "2024-01-01T00:00:00Z", SAME),
        record("revisit", "f", "https://h.test/x", "2024-01-01T00:00:00Z", SAME),
        record("warcinfo", "g", "", "2024-01-01T00:00:00Z", ""),
        "", None, "broken",
    ]
    got = check(spark, spark.createDataFrame([(r,) for r in raw], "raw string"))
    d = next(g for g in got if g[0] == "d")
    assert d[1:3] == ("resolved", "b") and d[4] == "body\r\n\r\nlater id"
    assert dict(d[3])["x"] == "new" and dict(d[3])["content-encoding"] == "gzip"


def test_reading_files(spark, tmp_path):
    records = [record("response", "a", "http://h.test/", "2024-01-01T00:00:00Z", FULL), record("revisit", "d", "http://h.test", "2024-01-01T00:00:01Z", SAME)]
    (tmp_path / "one.warc").write_bytes("\r\n\r\n".join([*records, ""]).encode())
    got = check(spark, warc.read_warc(spark, str(tmp_path)))
    assert [g[1] for g in got] == ["resolved"] and got[0][4] == "body\r\n\r\nmore"


@pytest.mark.parametrize(("url", "plain_url"), [
    ("HTTP://User@WWW.A.Test:80", "a.test/"), ("https://a.test:443/P?b=1&a=2#x", "a.test/P?a=2&b=1"),
    ("https://a.test:8443/?", "a.test:8443/"), ("nothing", None), (None, None), ("", None),
])
def test_canonical_urls(spark, url, plain_url):
    row = spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u")).alias("c")).first()
    assert row.c == plain_url


def test_empty_table(spark):
    assert warc.revisit_digest(spark.createDataFrame([], PAGES)).count() == 0
