from __future__ import annotations

from helpers import classified, exchanges, found_in_bodies, messages
from opatlas.operators import gates, requests

H1, H2 = "a" * 64, "B" * 64


def test_query_with_name_variables_and_newlines(spark):
    body = '{"query":"query Foo($id: ID!) {\\n\\tbar(id: $id, kind: \\"x\\") { id }\\n}","variables":{"id":"1"}}'
    assert found_in_bodies(spark, body) == [
        (0, "query", "Foo", None, 'query Foo($id: ID!) { bar(id: $id, kind: "x") { id } }')
    ]


def test_every_hash_counts(spark):
    one = '{"operationName":"P","extensions":{"persistedQuery":{"sha256Hash":"%s"}}}' % H1
    two = '{"a":{"sha256Hash":"%s"},"b":{"sha256Hash":"%s"}}' % (H1, H2)
    plain = '{"persistedQuery":{"hash":"%s"}}' % H2
    assert found_in_bodies(spark, one, two, plain) == [
        (0, "persisted", "P", H1, f"Persisted: {H1}"),
        (1, "persisted", "anonymous", H1, f"Persisted: {H1}"),
        (1, "persisted", "anonymous", H2, f"Persisted: {H2}"),
        (2, "persisted", "anonymous", H2, f"Persisted: {H2}"),
    ]


def test_document_ids(spark):
    assert found_in_bodies(
        spark,
        '{"doc_id":"1234567890","variables":{}}',
        '{"queryId":"5eb63bbbe01eeed093cb22bb8f5acdc3","operationName":"Q"}',
        '{"document_id":"operation.id","doc_id":"7"}',
    ) == [
        (0, "doc_id", "anonymous", "1234567890", "doc_id: 1234567890"),
        (1, "doc_id", "Q", "5eb63bbbe01eeed093cb22bb8f5acdc3", "queryId: 5eb63bbbe01eeed093cb22bb8f5acdc3 (Q)"),
        (2, "doc_id", "anonymous", "7", "doc_id: 7"),
        (2, "doc_id", "anonymous", "operation.id", "document_id: operation.id"),
    ]


def test_batch_is_read_part_by_part(spark):
    body = (
        ' [{"operationName":"A","query":"{ a { id } }","variables":{"x":[{"p":1},{"p":2}]}},\n'
        '{"operationName":"B","query":"query { b { id } }"}, {"doc_id":"9","operationName":"C"}]'
    )
    assert [row[1:4] for row in found_in_bodies(spark, body)] == [
        ("query", "A", None),
        ("query", "B", None),
        ("doc_id", "C", "9"),
    ]


def test_malformed_json_still_gives_its_query(spark):
    assert found_in_bodies(spark, '{"query":"query Foo { a }","variables":{')[0][1:3] == ("query", "Foo")


def test_urls(spark):
    paths = [
        "/g?query=query%20U%20%7Ba%7D&v=1",
        "/g?query=query+P+{a}",
        "/g?a=1&extensions=%7B%22persistedQuery%22%3A%7B%22sha256Hash%22%3A%22" + H1 + "%22%7D%7D&query={b{c}}",
        "/g?query=query Bad {x}%zz",
        "/g?other=1",
    ]
    df = exchanges(spark, [{"path": p, "method": "get"} for p in paths])
    rows = requests.http_ops(df).orderBy("capture_id", "ord").collect()
    assert [(r.capture_id, r.source, r.operation_type, r.operation_name, r.operation_body) for r in rows] == [
        (0, "HTTP_POST", "query", "U", "query U {a}"),
        (1, "HTTP_POST", "query", "P", "query P {a}"),
        (2, "PERSISTED_QUERY", "persisted", "anonymous", f"Persisted GET: {H1}"),
        (2, "HTTP_POST", "query", "anonymous", "{b{c}}"),
        (3, "HTTP_POST", "query", "Bad", "query Bad {x}%zz"),
    ]


def test_classification_cascade(spark):
    assert classified(
        spark,
        "query A { a } mutation B($x: Int) { b } fragment F on T { c }",
        "subscription { tick }",
        "... on User { handle }",
        "{ viewer { id } }",
        "{ __typename }",
        "{ id }",
        "no operation",
        "query D @live { a }",
        "query E @cached(ttl: 1) { a }",
        "myquery X { a }",
        name="Fallback",
    ) == [
        (0, "query", "A"),
        (0, "mutation", "B"),
        (0, "fragment", "F"),
        (1, "subscription", "Fallback"),
        (2, "fragment", "User"),
        (3, "query", "Fallback"),
        (4, "query", "Fallback"),
        (7, "query", "D"),
        (8, "query", "E"),
        (9, "query", "Fallback"),
    ]


def test_gates(spark):
    df = exchanges(
        spark,
        [
            {"body": '{"event":"query"}'},
            {"body": '{"query":"{ a { b } }"}', "method": "PUT"},
            {"body": '{"query":"{ a { b } }"}', "method": "post"},
            {"body": "query=%7Ba%7D"},
            {"body": None},
        ],
    )
    assert [r.capture_id for r in requests.http_ops(df).collect()] == [2]


def test_socket_messages(spark):
    query = '{"type":"start","payload":{"query":"subscription { tick { at } }","operationName":"Tick"}}'
    rows = [
        {"payload": query},
        {"payload": query, "direction": "SERVER_TO_CLIENT"},
        {"payload": query, "is_text": False},
        {"payload": '{"payload":{"operationName":"P","sha256Hash":"%s"}}' % H1},
        {"payload": '{"type":"ping"}'},
    ]
    found = requests.socket_ops(messages(spark, rows)).orderBy("capture_id").collect()
    assert [(r.capture_id, r.method, r.source, r.operation_type, r.operation_name, r.operation_body) for r in found] == [
        (0, "WS", "WEBSOCKET", "subscription", "Tick", "subscription { tick { at } }"),
        (3, "WS", "WEBSOCKET", "persisted", "P", f"WS Persisted: {H1}"),
    ]


def test_script_gate(spark):
    js = "application/javascript"
    texts = [
        (js, "const q = gql`query A { a }`;"),
        ("Text/JavaScript; charset=utf-8", "const q = gql`query A { a }`;"),
        ("text/html", "const q = gql`query A { a }`;"),
        (js, "gql`query A`"),
        (js, "function nothing(){return 42}"),
        (js, "query " + "x" * (5 * 1024 * 1024)),
    ]
    df = exchanges(spark, [{"method": "GET", "path": "/s.js", "content_type": c, "script": s} for c, s in texts])
    assert sorted(r.capture_id for r in gates.script_captures(df).collect()) == [0, 1, 3, 5]
    profile = {r.resp_content_type: r for r in gates.script_gate_profile(df).collect()}
    assert (profile[js].n_responses, profile[js].n_scripts, profile[js].n_admitted) == (4, 4, 3)


def test_a_megabyte_string_is_read_whole(spark):
    fields = " ".join(f"f{i}" for i in range(150_000))
    body = '{"query":"query Big { ' + fields.replace(" ", "\\n") + ' }"}'
    (row,) = found_in_bodies(spark, body)
    assert row[1:3] == ("query", "Big")
    assert row[4] == "query Big { " + fields + " }"


def test_batches_are_cut_by_their_structure(spark):
    names = lambda *bodies: [r[:3] for r in found_in_bodies(spark, *bodies)]
    lists = '[{"operationName":"A","query":"mutation A { add(items: [{a: 1}, {b: 2}]) { id } }","variables":{"l":[{"x":1},{"y":2}]}},{"query":"{ b { c } }","operationName":"B"}]'
    broken = lists[:-1]
    assert names(lists, broken) == [(0, "mutation", "A"), (0, "query", "B"), (1, "mutation", "A"), (1, "query", "B")]


def test_all_hashes_ids_and_queries_count(spark):
    h2 = "b" * 64
    body = '{"sha256Hash":"%s","x":{"sha256Hash":"%s"},"doc_id":"1","y":{"doc_id":"2"}}' % (H1, h2)
    assert [r[3] for r in found_in_bodies(spark, body)] == [H1, h2, "1", "2"]
    frames = messages(spark, [{"payload": body}])
    assert sorted(r.persisted_hash for r in requests.socket_ops(frames).collect()) == sorted([H1, h2])
    path = "/graphql?query=query%20One%20%7B%20a%20%7D&query=query%20Two%20%7B%20a%20%7D"
    urls = exchanges(spark, [{"method": "GET", "path": path}])
    assert sorted(r.operation_name for r in requests.http_ops(urls).collect()) == ["One", "Two"]


def test_comments_hold_no_fields(spark):
    (row,) = found_in_bodies(spark, r'{"query":"query A { # old { x\n id(of: \"#1\") }"}')
    assert row[4] == 'query A { id(of: "#1") }'


def test_a_text_is_read_once_though_items_are_tested(spark):
    """Dropping what holds no item must not read the texts again below the test."""
    df = exchanges(spark, [{"body": '{"query":"{ a }"}'}])

    def readings(found):
        return found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(")

    tested, untested = requests.http_exchange_items(df), requests.http_exchange_items(df, keep_empty=True)
    assert readings(tested) == readings(untested) > 0
