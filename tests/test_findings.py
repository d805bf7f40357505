from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helpers import exchanges, messages
from opatlas import fixed_values as V
from opatlas.functions.classify import classify
from opatlas.operators import findings, reports, requests
from opatlas.plans.catalogue import catalogue
from opatlas.session import new_shared_path
from opatlas.sources import capture_lines, captures, findings_csv

COLUMNS = [*findings.KEY, "url", "method", "source", "operation_body", "first_seen", "last_seen", "n_seen"]


def rows_of(df, columns=COLUMNS):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def traffic(spark, n=120, seed=5):
    random.seed(seed)
    bodies = [
        '{"query":"query A { a }"}',
        '{"query":"query A { a { b } }"}',
        '{"query":"query A { c { d } }"}',
        '{"query":"mutation B { b }"}',
        '{"sha256Hash":"%s"}' % ("d" * 64),
        '{"sha256Hash":"%s"}' % ("e" * 64),
        '[{"query":"query A { a }"},{"query":"query A { a }"}]',
    ]
    return exchanges(
        spark,
        [{"body": random.choice(bodies), "path": random.choice(["/g", "/h"]), "host": random.choice(["a", "b"])} for _ in range(n)],
    )


def of_exchanges(df):
    return findings.findings_of_exchanges(requests.http_exchange_items(df))


def expected(ops):
    """Findings by walking the operations in arrival order; an exchange counts a key once."""
    found, seen = {}, set()
    for r in ops.orderBy("ts", "capture_id", "ord").collect():
        key = (r.endpoint, r.operation_name, r.operation_type, r.persisted_hash or "")
        again = (r.capture_id, key) in seen
        seen.add((r.capture_id, key))
        if key not in found:
            found[key] = [r.url, r.method, r.source, r.operation_body, r.ts, r.ts, 1]
            continue
        entry = found[key]
        if len(r.operation_body) > len(entry[3]):
            entry[3] = r.operation_body
        entry[5], entry[6] = r.ts, entry[6] + (not again)
    return sorted((*key, *entry) for key, entry in found.items())


def test_findings_equal_the_walk_in_arrival_order(spark):
    df = traffic(spark)
    ops = classify(requests.http_items(df))
    want = expected(ops)
    assert any(n != count for (*_, n), count in zip(want, (r["count"] for r in ops.groupBy(*findings.KEY).count().orderBy(*findings.KEY).collect()), strict=True))
    assert rows_of(findings.merge(of_exchanges(df))) == want
    assert rows_of(findings.merge(findings.from_ops(findings.once_per(ops, ["capture_id"])))) == want


def test_merging_parts_equals_the_whole_and_is_idempotent(spark):
    df = traffic(spark, seed=6)
    parts = [
        findings.merge(of_exchanges(df.where(F.col("capture_id") % 3 == i)))
        for i in range(3)
    ]
    whole = findings.merge(of_exchanges(df))
    union = parts[2].unionByName(parts[0]).unionByName(parts[1])
    assert rows_of(findings.merge(union)) == rows_of(whole)
    assert rows_of(findings.merge(whole)) == rows_of(whole)


def test_pre_aggregation_is_a_hash_aggregate(spark):
    plan = findings.distinct_exchanges(requests.http_exchange_items(traffic(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_a_hot_key_holding_nearly_all_rows(spark):
    base = traffic(spark, n=10)
    hot = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2000)))).withColumn(
        "capture_id", F.col("capture_id") * 10_000 + F.col("i")
    ).drop("i")
    found = findings.merge(of_exchanges(hot))
    total = found.agg(F.sum("n_seen")).first()[0]
    keys = ["endpoint", "operation_name", "operation_type", "persisted_hash", "capture_id"]
    assert total == requests.http_ops(base).select(*keys).distinct().count() * 2001


def test_numbers_follow_the_order_over_many_partitions(spark):
    df = spark.range(5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("v"), F.lit("x").alias("k"))
    numbered = findings.numbered(df.repartition(9), ["v"], "no")
    assert numbered.where("no <> v + 1").count() == 0
    assert numbered.count() == 5000


def test_table_columns_labels_and_sorting(spark):
    found = findings.merge(of_exchanges(traffic(spark)))
    table = findings.findings_table(found)
    rows = table.orderBy("row_no").collect()
    assert [r.row_no for r in rows] == list(range(1, len(rows) + 1))
    assert rows[0].seen_at == "00:00:00"
    assert {r.source_label for r in rows} == {V.SOURCE_LABELS["HTTP_POST"], V.SOURCE_LABELS["PERSISTED_QUERY"]}
    names = [r.operation_type for r in findings.sorted_by(table, "operation_type", descending=True).collect()]
    assert names == sorted(names, reverse=True)
    assert len(table.columns) == 9


def test_filters_and_cube_agree(spark):
    found = findings.merge(of_exchanges(traffic(spark)))
    cube = {(r.source, r.operation_type): r.visible for r in reports.counts_cube(found).collect()}
    total = found.count()
    assert cube[("All", "All")] == total
    labels = V.SOURCE_LABELS
    for (source, kind), visible in cube.items():
        chosen = findings.filter_findings(
            found, None if source == "All" else labels[source], None if kind == "All" else kind
        )
        assert chosen.count() == visible
    assert {r.total for r in reports.counts_cube(found).collect()} == {total}


def test_unknown_labels_count_as_request_bodies(spark):
    df = spark.createDataFrame([(text,) for text in [*V.SOURCE_LABELS.values(), "?"]], "label string")
    got = [r.s for r in df.select(findings.source_of_label(F.col("label")).alias("s")).collect()]
    assert got == [*V.SOURCE_LABELS, "HTTP_POST"]


def test_new_keys(spark):
    df = traffic(spark)
    stored = findings.merge(of_exchanges(df.where("path = '/g'")))
    whole = findings.merge(of_exchanges(df))
    assert {r.endpoint for r in findings.new_keys(whole, stored).collect()} == {"/h"}


def test_endpoint_inventory(spark):
    df = exchanges(
        spark,
        [
            {"body": '{"query":"query A { a }"}'},
            {"body": '{"query":"query A { a }"}', "host": "b.test"},
            {"body": '[{"query":"query A { a }"},{"query":"query B { a }"}]'},
            {"body": '{"operationName":"X"}', "path": "/other"},
            {"body": "nothing", "path": "/no"},
            {"body": '{"query":"query A { a }"}', "host": "c.test"},
        ],
    )
    # The column names the host, whatever the URL has for it.
    df = df.withColumn("url", F.when(F.col("host") == "c.test", "https://C.test:8443/graphql").otherwise(F.col("url")))
    got = reports.endpoint_inventory(df).orderBy("host", "path").collect()
    assert [(r.host, r.path, r.first_seen.second, r.n_calls, r.n_operations) for r in got] == [
        ("a.test", "/graphql", 0, 2, 2),
        ("a.test", "/other", 3, 1, 0),
        ("b.test", "/graphql", 1, 1, 1),
        ("c.test", "/graphql", 5, 1, 1),
    ]


def test_csv_round_trip_folds_newlines_only(spark):
    found = spark.createDataFrame(
        [
            ("/g", "A", "query", "", "u", "POST", "HTTP_POST", 'query A { a(s: "x, y") }\nline\r two'),
            ("/g", " B ", "doc_id", "7", "u", "GET", "JS_EXECUTED", " back\\slash, 'quote' \"\" "),
            ("/g", "anonymous", "query", "", "", "WS", "WEBSOCKET", ""),
        ],
        "endpoint string, operation_name string, operation_type string, persisted_hash string, url string,"
        " method string, source string, operation_body string",
    )
    path = new_shared_path(spark, "csv")
    findings_csv.write_findings_csv(found, path)
    back = findings_csv.read_findings_csv(spark, path)
    assert back.where("not is_valid").count() == 0
    want = found.withColumn("operation_body", F.regexp_replace(F.regexp_replace("operation_body", "\n", " "), "\r", ""))
    assert rows_of(back, want.columns) == rows_of(want, want.columns)


def write_text(spark, lines, name):
    path = new_shared_path(spark, name)
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return path


HEADER = ",".join(V.CSV_COLUMNS)


def test_csv_import_rules(spark):
    path = write_text(
        spark,
        [
            HEADER,
            '"/g","POST","HTTP POST Body","query","A","","u1","first"',
            '"/g","POST","HTTP POST Body","query","A","","u2","repeat"',
            '"/g","POST","No such label","query","B","","u","say ""hi"", you"',
            "",
            '"/g","POST","HTTP POST Body","query","Short","","u"',
            '/g,GET,JS/Static File,persisted,P,abc,u,"body",extra',
            '"/g","POST","HTTP POST Body","query","Known","","u","body"',
        ],
        "csv",
    )
    rows = findings_csv.read_findings_csv(spark, path)
    stored = spark.createDataFrame(
        [("/g", "Known", "query", "")],
        "endpoint string, operation_name string, operation_type string, persisted_hash string",
    )
    new = findings_csv.importable(rows, stored).orderBy("operation_name").collect()
    assert [(r.operation_name, r.source, r.persisted_hash, r.url, r.operation_body) for r in new] == [
        ("A", "HTTP_POST", "", "u1", "first"),
        ("B", "HTTP_POST", "", "u", 'say "hi", you'),
        ("P", "JS_FILE", "abc", "u", "body"),
    ]
    tally = reports.import_tallies(rows, stored).first()
    assert tuple(tally) == (6, 1, 1, 1, 3)
    (short,) = findings_csv.rejected_rows(rows).collect()
    assert (short.line_no, short.text) == (6, '"/g","POST","HTTP POST Body","query","Short","","u"')


def test_line_numbers_over_files_and_splits(spark):
    path = new_shared_path(spark, "csv")
    for name in "ab":
        lines = [HEADER] + [f"e,{name}" if i % 7 == 3 else f"e,m,s,t,{name}{i},h,u,b" for i in range(2, 3000)]
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        found = findings_csv.rejected_rows(findings_csv.read_findings_csv(spark, path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = sorted((f"e,{name}", i) for name in "ab" for i in range(2, 3000) if i % 7 == 3)
    assert sorted((r.text, r.line_no) for r in found) == want
    assert len({(r.file, r.text) for r in found}) == 2


def test_csv_without_the_required_columns_is_rejected(spark):
    path = write_text(spark, ["Endpoint,Method", "a,b"], "csv")
    with pytest.raises(ValueError, match="OperationType"):
        findings_csv.read_findings_csv(spark, path)


def test_every_file_of_an_import_needs_the_header(spark):
    path = write_text(spark, [HEADER, '"/g","POST","HTTP POST Body","query","A","","u","b"'], "csv")
    spark.createDataFrame([("a,b,c,d,e,f,g,h",), ("1,2,3,4,5,6,7,8",)], "value string").coalesce(1).write.mode(
        "append"
    ).text(path)
    with pytest.raises(ValueError, match="a,b,c"):
        findings_csv.read_findings_csv(spark, path)


def test_capture_lines(spark):
    path = write_text(
        spark,
        [
            '{"query":"query A { a \\n b }","operationName":"A","variables":{"x":1}}',
            '{"query":"{ a { b } }","operationName":"Named"}',
            ' {"doc_id":"42","operationName":"","variables":{}}',
            '{"doc_id":"43","query":"query Both { a }"}',
            "not json",
            '{"query":"query Trunc { a',
            '{"variables":{}}',
            '[{"query":"query InArray { a }","doc_id":"44"},{"query":"{ short }"},{"x":1}]',
        ],
        "lines",
    )
    ops = capture_lines.capture_line_ops(capture_lines.read_capture_lines(spark, path))
    lines, rejected = capture_lines.ingested(spark, path)
    columns = ["operation_type", "operation_name", "persisted_hash", "operation_body"]
    assert rows_of(capture_lines.capture_line_ops(lines), columns) == rows_of(ops, columns)
    assert sorted((r.line_no, r.text) for r in rejected.collect()) == [(5, "not json"), (6, '{"query":"query Trunc { a')]
    assert rows_of(ops, columns) == [
        ("doc_id", "anonymous", "42", "doc_id: 42 (anonymous)"),
        ("doc_id", "anonymous", "44", "doc_id: 44 (anonymous)"),
        ("query", "A", "", "query A { a b }"),
        ("query", "Both", "", "query Both { a }"),
        ("query", "InArray", "", "query InArray { a }"),
        ("query", "Named", "", "{ a { b } }"),
    ]


@pytest.mark.parametrize("depth", [1, 2, 3, 60])
def test_objects_in_arrays_of_any_depth(spark, depth):
    inner = '{"query":"query Nest { a(s: \\"}]{\\") }","list":[{"query":"query Inside { b }"}]},{"doc_id":"45"}'
    lines = ["[" * depth + inner + "]" * depth, '[{"query":"query Cut { a }"},', '[[{"query":"query Two { a }"}],[],{"doc_id":46}]']
    found = spark.createDataFrame([(x,) for x in lines], "line string")
    got = rows_of(capture_lines.capture_line_ops(found), ["operation_type", "operation_name", "persisted_hash"])
    assert got == [("doc_id", "anonymous", "45"), ("doc_id", "anonymous", "46"), ("query", "Nest", ""), ("query", "Two", "")]


def test_catalogue_covers_all_sources_and_keeps_the_earlier_tag(spark):
    script = 'var p=" id name ";var q="query Cat { me { id ".concat(p).concat(" } }");gql`query Tag { a { b } }`;' + " " * 40
    rows = [
        {"method": "GET", "path": "/s.js", "content_type": "text/javascript", "script": script},
        {"body": '{"query":"query A { a }"}'},
    ]
    socket = messages(spark, [{"payload": '{"query":"subscription S { s }"}'}])
    found = catalogue(exchanges(spark, rows), socket, include_assembled=True)
    got = {(r.operation_name, r.source): r.operation_body for r in found.collect()}
    assert got == {
        ("Cat", "JS_FILE"): "query Cat { me { id id name } }",
        ("Tag", "JS_FILE"): "query Tag { a { b } }",
        ("A", "HTTP_POST"): "query A { a }",
        ("S", "WEBSOCKET"): "subscription S { s }",
    }


def test_one_text_at_many_urls_is_classified_once(spark):
    body = '{"query":"query Same { a }"}'
    rows = [{"body": body, "path": f"/graphql?trace={i}"} for i in range(1000)] + [{"body": body, "path": "/other"}]
    items = findings.with_item_id(requests.http_items(exchanges(spark, rows)))
    assert items.count() == 1001 and findings.item_operations(items).count() == 1
    found = findings.merge(findings.findings_of_exchanges(requests.http_exchange_items(exchanges(spark, rows))))
    assert found.count() == 1001
    assert {r.operation_name for r in found.collect()} == {"Same"}


def test_items_are_told_apart_by_their_parts(spark):
    """Row numbers tell units apart, and ids items whose texts run into each other."""
    rows = [("json", "a", "b", None), ("json", "a 1 b", "", None), ("json", "a", None, "b"), ("json", "a", "", "b"),
            ("json", "a", "b", ""), ("json", "a", None, None), ("json", "a", "", None), ("json", None, "a", None)]
    items = spark.createDataFrame(rows + rows, "form string, text string, name string, hash string")
    found = findings.with_item_id(items)
    assert found.select("item_id").distinct().count() == len(rows)
    assert dict(found.dtypes)["item_id"] == "binary"
    units = findings.distinct_exchanges(requests.http_exchange_items(traffic(spark)))
    assert dict(units.dtypes)["unit"] == "bigint"


def test_stored_findings_are_joined_as_they_lie(spark):
    found = catalogue(traffic(spark), messages(spark, [{"payload": "-"}]))
    half = found.where("operation_name = 'A'")
    path = new_shared_path(spark, "findings")
    captures.write_findings(half, path, buckets=6)
    stored = captures.read_findings(spark, path)
    assert rows_of(stored) == rows_of(half)
    arrived_path = new_shared_path(spark, "arrived")
    found.write.parquet(arrived_path)
    new = findings.new_keys(spark.read.parquet(arrived_path), stored)
    want = found.where("operation_name <> 'A'")
    assert want.count() > 0 and half.count() > 0
    assert rows_of(new) == rows_of(want)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # of the findings that arrived
    assert plan.index("Exchange") < plan.index("FileScan") < plan.index("Bucketed: true")
    nothing = new_shared_path(spark, "findings")
    captures.write_findings(found.where("false"), nothing)
    assert captures.read_findings(spark, nothing).count() == 0
