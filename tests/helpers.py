"""Builders for small captures."""

from __future__ import annotations

from datetime import datetime, timedelta

from opatlas.functions.classify import classify
from opatlas.operators import requests, scripts
from opatlas.sources.captures import HTTP_EXCHANGES, SOCKET_MESSAGES

START = datetime(2024, 1, 1)


def at(second: int) -> datetime:
    return START + timedelta(seconds=second)


def exchange(i, body=None, path="/graphql", method="POST", host="a.test", content_type=None, script=None):
    return (i, at(i), host, path, f"https://{host}{path}", method, body, content_type, script)


def exchanges(spark, rows):
    return spark.createDataFrame([exchange(i, **row) for i, row in enumerate(rows)], HTTP_EXCHANGES)


def messages(spark, rows):
    data = [
        (i, at(i), "https://a.test/ws", "/ws", row.get("direction", "CLIENT_TO_SERVER"), row.get("is_text", True), row["payload"])
        for i, row in enumerate(rows)
    ]
    return spark.createDataFrame(data, SOCKET_MESSAGES)


def found_in_bodies(spark, *bodies):
    """(capture, type, name, hash, body) of request bodies, in order."""
    ops = requests.http_ops(exchanges(spark, [{"body": b} for b in bodies]))
    rows = ops.orderBy("capture_id", "ord").collect()
    return [(r.capture_id, r.operation_type, r.operation_name, r.persisted_hash, r.operation_body) for r in rows]


def found_in_scripts(spark, *texts, extractors=None):
    """(script, type, name, hash, body) of script texts, in order."""
    bundles = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "bundle_id string, body string")
    rows = scripts.bundle_ops(bundles, extractors).orderBy("bundle_id", "ord").collect()
    return [(int(r.bundle_id), r.operation_type, r.operation_name, r.persisted_hash, r.operation_body) for r in rows]


def classified(spark, *texts, name=None):
    """(text number, type, name) of operation texts."""
    rows = [("plain", t, name, None, i * 1000) for i, t in enumerate(texts)]
    items = spark.createDataFrame(rows, "form string, text string, name string, hash string, ord bigint")
    return [
        (r.ord // 1000, r.operation_type, r.operation_name)
        for r in classify(items).orderBy("ord").collect()
    ]
