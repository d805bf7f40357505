from __future__ import annotations

from pyspark.sql import functions as F

from helpers import exchanges, found_in_scripts, messages
from opatlas.functions import text as T
from opatlas.operators import constants, gates, scripts
from opatlas.plans.catalogue import catalogue
from opatlas.session import new_shared_path

H = "c" * 64


def apply(spark, function, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.t for r in df.select("i", function(F.col("t")).alias("t")).orderBy("i").collect()]


def test_unescape(spark):
    assert apply(spark, T.unescape_json, r"a\nb\tc\"d\\e\r") == ['a\nb\tc"d\\e\\r']
    assert apply(spark, T.unescape_script, r"a\nb\rc\'d\"e") == ['a\nb\rc\'d"e']


def test_flatten_concat(spark):
    assert apply(
        spark,
        T.flatten_concat,
        '"query A { a ".concat(x).concat(" b ").concat(f("c", g(1))) }',
        "no call",
        'open "a".concat(f("x") }',
        'end .concat(',
    ) == ['"query A { a " b c }', "no call", 'open "a"x', "end .concat("]


def test_sanitize(spark):
    assert apply(
        spark,
        T.keep_operation_tokens,
        'query A($n: Int = -1, $f: Float = .5) { a(s: "k;e\\"p") ...B @x | y } # gone\n;`\'+*/',
        "var return this from document name",
        'a "unclosed',
        "é~ok",
    ) == [
        'query A($n: Int = -1, $f: Float = .5) { a(s: "k;e\\"p") ...B @x | y } \n',
        "     name",
        "a unclosed",
        "ok",
    ]


def test_trim_after_last_block(spark):
    assert apply(
        spark, T.trim_after_last_block, "query A { a { b } } tail", "a } b {", "{ a", "no braces", "{a}{b} x", "}{"
    ) == ["query A { a { b } }", "a } b {", "{ a", "no braces", "{a}{b}", "}{"]


def test_clean_all_steps(spark):
    text = 'query A { a " + x.y(1) + " b ${c.d} n.includes("STAY")?y:"" \\n d } }, e = 1'
    assert apply(spark, T.clean_script_text, text) == ["query A { a b d } }, e = 1"]


def test_cleaning_of_long_runs_stays_linear(spark):
    blob = "Zm9vYmFy1234" * 4000
    assert apply(spark, T.clean_script_text, f"query A {{ a }} {blob}", "a + " + " " * 40_000 + "b") == ["query A { a }", "a b"]
    assert apply(spark, T.drop_script_syntax, "9abc?x:y z.q(1) ? a : b", 'x +  "y" +z') == ["9 ", "x y "]


def test_capitalize_touches_one_letter(spark):
    assert apply(spark, T.capitalize, "fooBar baz", "", "x") == ["FooBar baz", "", "X"]


def test_tagged_and_raw(spark):
    text = "a=gql`\n query A { a }\n`;b=graphql `fragment F on T { f }`;gql`short`;"
    assert [r[1:3] for r in found_in_scripts(spark, text, extractors=["tagged"])] == [
        ("query", "A"),
        ("fragment", "F"),
    ]
    text = 'x("query Deep($a: In) { a { b { c } } } + rest {");myquery Foo { x }'
    assert [r[1:] for r in found_in_scripts(spark, text, extractors=["raw"])] == [
        ("query", "Deep", None, "query Deep($a: In) { a { b { c } } }")
    ]


def test_raw_operation_deeper_than_the_pattern(spark):
    nested = "query Deep {" + "a{" * 40 + "x" + "}" * 40 + "}"
    rows = found_in_scripts(spark, f"p='{nested}';q={{}}", extractors=["raw"])
    assert [r[1:] for r in rows] == [("query", "Deep", None, nested)]
    rows = found_in_scripts(spark, f"p='{nested}';q={{}}", extractors=["compact"])
    assert [r[1:] for r in rows] == [("query", "Deep", None, nested)]


def test_raw_operation_that_never_closes_ends_at_the_next_one(spark):
    text = "query Open { a { b } c " + "d " * 30_000
    ((_, kind, name, _, body),) = found_in_scripts(spark, text, extractors=["raw"])
    assert (kind, name) == ("query", "Open")
    assert body == text.strip()
    many = "".join(f"query Q{i} {{ a{i} {{ b " for i in range(1000))
    rows = found_in_scripts(spark, many, extractors=["raw"])
    assert [r[2] for r in rows] == [f"Q{i}" for i in range(1000)]
    assert rows[5][4] == "query Q5 { a5 { b"


def test_a_long_operation_is_whole(spark):
    text = "query Big { " + "field " * 11_000 + "}"
    ((*_, body),) = found_in_scripts(spark, "x=" + text + ";", extractors=["raw"])
    assert body == text


def test_operations_inside_an_operation_are_found(spark):
    text = "query Outer { a subscription Inner { b } }"
    assert [r[2] for r in found_in_scripts(spark, text, extractors=["raw"])] == ["Outer", "Inner", "Inner"]


def test_minified_shapes(spark):
    def names(text, extractor):
        return [r[1:3] for r in found_in_scripts(spark, text, extractors=[extractor])]

    assert names('a.b = "query Foo { a }";c="...  on T { x }"', "property") == [("query", "Foo"), ("fragment", "T")]
    assert names('["query Foo {\\n ab }","mutation B","query F {ab cd}"]', "quoted") == [("query", "Foo"), ("query", "F")]
    assert names("x=query Foo{bar{baz{id}}},query No{}", "compact") == [("query", "Foo"), ("query", "No")]
    assert names('{query:"mutation Baz($id:ID!){a}"}', "query_field") == [("mutation", "Baz")]
    assert names('{body:"query Foo{a}"}', "body_field") == [("query", "Foo")]
    assert names('{text:"query A{a}",queryText="query B{b}",operationText:"query C{c}"}', "text_field") == [
        ("query", "A"), ("query", "B"), ("query", "C"),
    ]


def test_request_nodes_in_both_orders(spark):
    text = '{kind:"Request",name:"FooQuery",id:"h1",text:null}{"kind":"Request","id":"h2","name":"Bar"}{kind:"Other",name:"N",id:"h3"}'
    assert [r[1:] for r in found_in_scripts(spark, text, extractors=["node_name_first", "node_id_first"])] == [
        ("doc_id", "FooQuery", "h1", "Relay doc_id: h1 (FooQuery)"),
        ("doc_id", "Bar", "h2", "Relay doc_id: h2 (Bar)"),
    ]


def test_ids_take_the_first_name_around_them(spark):
    text = 'n={name:"A"};' + "x" * 10 + 'q={queryID:"1",operationName:"B"};' + "y" * 300 + 'r={queryId:"2"};'
    assert [r[2:] for r in found_in_scripts(spark, text, extractors=["query_id"])] == [
        ("A", "1", "Meta queryID: 1 (A)"),
        ("anonymous", "2", "Meta queryID: 2 (anonymous)"),
    ]


def test_a_name_is_not_borrowed_across_another_id(spark):
    text = 'a={doc_id:"1",name:"One"};b={doc_id:"2",x:0};c={doc_id:"3"}'
    assert [r[2:4] for r in found_in_scripts(spark, text, extractors=["doc_id"])] == [
        ("One", "1"), ("One", "2"), ("anonymous", "3"),
    ]


def test_hex_ids_need_operation_words_nearby(spark):
    near = 'm={"operationName":"P",id:"%s"}' % H
    far = "query" + " " * 200 + 'id:"%s"' % H
    assert [r[1:4] for r in found_in_scripts(spark, near, far, extractors=["hex_id"])] == [("persisted", "P", H)]


def test_long_identifier_runs_stay_linear(spark):
    text = "x=" + "a." * 300_000 + ";" + 'n.q="query A { a }";'
    assert [r[2] for r in found_in_scripts(spark, text, extractors=["property"])] == ["A"]
    bundles = spark.createDataFrame([("0", text)], "bundle_id string, body string")
    assert [r.name for r in constants.constants(bundles).collect()] == ["q"]


def bundle(spark, text):
    return spark.createDataFrame([("b", text)], "bundle_id string, body string")


def test_constants_last_assignment_wins_and_properties_override(spark):
    text = 'var a="first value",b="tiny",c=\'no\';let a="second value";x.c="prop value";o.a="third\\nvalue";'
    rows = {r.name: r.value for r in constants.constants(bundle(spark, text)).collect()}
    assert rows == {"a": "third\nvalue", "b": "tiny", "c": "prop value"}


def test_chain_resolution(spark):
    text = (
        'var a=" alpha ",b=" beta beta ",c=" gamma ";'
        'f("query Quux { x ".concat(a).concat(n.is("B")?b:"").concat(t?a:c).concat(u(1)?v?a:b:c)'
        '.concat(missing).concat("  ").concat(" lit }"));'
    )
    table = constants.constants(bundle(spark, text))
    (row,) = constants.assembled(bundle(spark, text), table).collect()
    assert row["query"] == "query Quux { x alpha beta beta alpha gamma lit }"


def test_chain_needs_an_operation_and_may_sit_inside_another_chain(spark):
    text = 'g("not an operation at all".concat("query Inner { abc ".concat(" bcd }")))'
    table = constants.constants(bundle(spark, text))
    assert [r["query"] for r in constants.assembled(bundle(spark, text), table).collect()] == ["query Inner { abc bcd }"]


def test_captures_of_a_bundle(spark):
    text = 'var q="query Standalone { a b c }",f="... on User { id }",n="not one of them";' + "/*" + "-" * 60 + "*/"
    ops = constants.assembled_ops(bundle(spark, text)).orderBy("ord").collect()
    assert [(r.source, r.operation_type, r.operation_name) for r in ops] == [
        ("JS_EXECUTED", "query", "Standalone"),
        ("JS_EXECUTED", "fragment", "User"),
    ]


def test_each_distinct_bundle_is_read_once_and_found_everywhere(spark):
    text = "const q = gql`query A { a }`;"
    rows = [
        {"method": "GET", "path": f"/{i % 3}.js", "content_type": "text/javascript", "script": text} for i in range(30)
    ]
    captures = exchanges(spark, rows)
    admitted = gates.script_captures(captures)
    seen = scripts.sightings(admitted)
    bundles = scripts.distinct_bundles(admitted)
    assert bundles.count() == 1
    ops = scripts.at_sightings(scripts.bundle_ops(bundles, ["tagged"]), seen).collect()
    assert sorted((r.endpoint, r.n_seen) for r in ops) == [("/0.js", 10), ("/1.js", 10), ("/2.js", 10)]
    assert [r.n_served for r in scripts.bundle_inventory(admitted).collect()] == [30]


def test_repeated_capture_ids_keep_their_texts_apart(spark):
    rows = [
        {"method": "GET", "path": f"/{n}.js", "content_type": "text/javascript", "script": f"gql`query {n * 4} {{ a }}`"}
        for n in "ABA"
    ]
    captures = exchanges(spark, rows).withColumn("capture_id", F.lit(1).cast("bigint"))
    found = catalogue(captures, messages(spark, [{"payload": "-"}])).collect()
    assert sorted((r.endpoint, r.operation_name, r.n_seen) for r in found) == [("/A.js", "AAAA", 2), ("/B.js", "BBBB", 1)]


def test_other_bodies_stay_out_of_the_exchange(spark):
    captures = exchanges(spark, [{"method": "GET", "path": "/x", "content_type": "text/html", "script": "<p>"}])
    path = new_shared_path(spark, "captures")
    captures.write.parquet(path)
    bundles = scripts.distinct_bundles(gates.script_captures(spark.read.parquet(path)))
    plan = bundles._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert "resp_content_type" in below[: below.index("FileScan")]  # the gate's filter


def test_short_scripts_and_constants_take_part(spark):
    text = 'var q="query Cat { me { ".concat("id").concat(" } }");'
    ops = constants.assembled_ops(bundle(spark, text)).collect()
    assert "query Cat { me { id } }" in [r.operation_body for r in ops]
    text = 'var i=" id ";var q="query Category { me {".concat(i).concat("name } }");'
    ops = constants.assembled_ops(bundle(spark, text)).collect()
    assert "query Category { me { id name } }" in [r.operation_body for r in ops]


def test_captures_equal_in_their_beginning_are_two(spark):
    start = "query Big { " + "f " * 200
    text = f'var a="{start} one }}",b="{start} two }}";'
    assert constants.script_captures(bundle(spark, text)).count() == 2


def test_a_script_of_six_megabytes_is_read(spark):
    text = "gql`query Far { a }`;" + "x " * 3_000_000
    captures = exchanges(spark, [{"method": "GET", "path": "/s.js", "content_type": "text/javascript", "script": text}])
    found = catalogue(captures, messages(spark, [{"payload": "-"}])).collect()
    assert [r.operation_name for r in found] == ["Far"]
