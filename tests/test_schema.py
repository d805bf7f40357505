from __future__ import annotations

import random
import re
import time

from opatlas.operators import schema, tokens, variables
from opatlas.session import new_shared_path

_COLUMNS = "operation_type string, operation_name string, operation_body string, first_order decimal(38,0), first_ord bigint"


def found(spark, *ops):
    """Findings from (type, name, body) in arrival order."""
    from decimal import Decimal

    return spark.createDataFrame([(t, n, b, Decimal(i), 0) for i, (t, n, b) in enumerate(ops)], _COLUMNS)


def typed(spark, *bodies):
    df = found(spark, *[("query", f"Q{i}", b) for i, b in enumerate(bodies)])
    return tokens.distinct_bodies(df)


def fields_of(spark, *bodies):
    rows = schema.schema_fields(schema.typed_selections(typed(spark, *bodies)))
    return sorted((r.type_name, r.field, r.return_type) for r in rows.collect())


def roots_of(spark, *bodies):
    rows = schema.typed_selections(typed(spark, *bodies))
    return sorted((r.root, r.field, r.return_type) for r in schema.schema_root(rows, schema.schema_types(rows)).collect())


def args_of(spark, *bodies):
    bodies = typed(spark, *bodies)
    rows = schema.schema_args(schema.typed_selections(bodies), variables.declarations(bodies))
    return sorted((r.type_name, r.field, r.argument, r.argument_type) for r in rows.collect())


def test_nested_fields_and_roots(spark):
    body = "query A { user(id: 1) { id name: fullName owner { id } } plain }"
    assert fields_of(spark, body) == [
        ("User_Response", "fullName", "Unknown"),
        ("User_Response", "id", "Unknown"),
        ("User_Response", "owner", "User_Response_Owner"),
        ("User_Response_Owner", "id", "Unknown"),
    ]
    assert roots_of(spark, body) == [("query", "plain", "Unknown"), ("query", "user", "User_Response")]


def test_spreads_inline_fragments_directives_and_meta_fields_are_left_out(spark):
    body = (
        "query A @dir(x: 1) { a @include(if: $b) { __typename x @skip(if: true) ...Bits ... on T { hidden { deep } } "
        "... @defer { y } __meta { z } } m { __typename } }"
    )
    assert fields_of(spark, body) == [("A_Response", "x", "Unknown")]
    assert roots_of(spark, body) == [("query", "a", "A_Response"), ("query", "m", "Unknown")]


def test_unknown_is_upgraded_once_children_are_seen(spark):
    assert fields_of(spark, "{ a { b } }", "{ a { b { c } } }", "{ a { b } }") == [
        ("A_Response", "b", "A_Response_B"),
        ("A_Response_B", "c", "Unknown"),
    ]


def test_definitions_of_a_document_are_kept_apart(spark):
    body = "query A { a { id } } mutation B { b } fragment F on Item { tags(kind: \"x}y{\") { n } } fragment G on Query { g { h } }"
    assert roots_of(spark, body) == [
        ("mutation", "b", "Unknown"),
        ("query", "a", "A_Response"),
        ("query", "g", "G_Response"),
    ]
    assert fields_of(spark, body) == [
        ("A_Response", "id", "Unknown"),
        ("G_Response", "h", "Unknown"),
        ("Item", "tags", "Item_Tags"),
        ("Item_Tags", "n", "Unknown"),
    ]


def test_inline_fragment_documents_belong_to_their_type(spark):
    assert fields_of(spark, "... on User { handle }") == [("User", "handle", "Unknown")]


def test_any_depth(spark):
    body = "{" + "".join(f"f{i}{{" for i in range(60)) + "x" + "}" * 61
    rows = tokens.selections(typed(spark, body)).where("name = 'x'").collect()
    assert rows[0].path == [f"f{i}" for i in range(60)]


def test_argument_types(spark):
    body = (
        'query A($id: ID!, $in: [In!]! = [{a: 1}], $n: Int = 10) { f(id: $id, in: $in, n: $n, i: -5, d: 1.5, e: 1e5, b: true, '
        's: "a, b: c", u: UP_1, l: lower, o: {x: 1, y: [2]}, li: [1, 2], nu: null, un: $undeclared) '
        "{ g(x: 1) @include(if: $id) } }"
    )
    got = {(a, b): c for _, a, b, c in args_of(spark, body)}
    assert got == {
        ("f", "id"): "ID!", ("f", "in"): "[In!]!", ("f", "n"): "Int", ("f", "i"): "Int", ("f", "d"): "Float",
        ("f", "e"): "Unknown", ("f", "b"): "Boolean", ("f", "s"): "String", ("f", "u"): "String",
        ("f", "l"): "Unknown", ("f", "o"): "Unknown", ("f", "li"): "Unknown", ("f", "nu"): "Unknown",
        ("f", "un"): "Unknown", ("g", "x"): "Int",
    }


def test_first_use_of_an_argument_decides(spark):
    assert args_of(spark, "{ f(x: 1) }", "{ f(x: true, y: 2.5) }") == [
        ("Query", "f", "x", "Int"),
        ("Query", "f", "y", "Float"),
    ]


def test_variables_may_be_separated_by_spaces_and_have_defaults(spark):
    df = found(
        spark,
        ("query", "A", "query A($id: ID! $list: [CreateInput!]! = [], $n: Int = 10 , $s: String) { a }"),
        ("mutation", "B", "query A($x: Int) { a } mutation B($y: Float) { b }"),
        ("query", "Fallback", "query ($v: Custom) { a }"),
        ("query", "None", "query None { a }"),
        ("doc_id", "D", "doc_id: 1"),
    )
    got = [(r.operation_name, r.position, r.variable, r.variable_type) for r in variables.variables(df).orderBy("operation_name", "position").collect()]
    assert got == [
        ("A", 0, "id", "ID!"),
        ("A", 1, "list", "[CreateInput!]!"),
        ("A", 2, "n", "Int"),
        ("A", 3, "s", "String"),
        ("B", 0, "y", "Float"),
        ("Fallback", 0, "v", "Custom"),
    ]
    templates = {r.operation_name: r.variables_template for r in variables.variables_template(df).collect()}
    assert templates == {
        "A": '{"id":"","list":{},"n":0,"s":""}',
        "B": '{"y":0.0}',
        "Fallback": '{"v":{}}',
        "None": "{}",
    }
    inputs = schema.schema_inputs(
        tokens.distinct_bodies(df), spark.createDataFrame([("Custom",)], "type_name string")
    )
    assert [r.input_type for r in inputs.collect()] == ["CreateInput"]


def test_structure_report(spark):
    df = found(spark, ("query", "A", 'query A($x: In = {a: 1}) { a(o: {b: 2}) { c } } fragment F on T { d }'))
    row = tokens.structure_report(df).first()
    assert (row.max_depth, row.closing_depth, row.n_fields, row.n_arguments, row.n_definitions) == (2, 0, 3, 1, 2)


def test_schema_text(spark):
    df = found(
        spark,
        ("mutation", "M", "mutation M($in: NewThing!) { add(thing: $in, dry: false) { ok } }"),
        ("query", "Q", "query Q { zed { b a(x: 1) { c } } alpha }"),
        ("query", "Q2", "query Q2 { zed { early __typename } }"),
    )
    lines = [r.line for r in schema.schema_lines(df).orderBy("line_no").collect()]
    assert lines == [
        *schema.PREAMBLE,
        "schema {", "  query: Query", "  mutation: Mutation", "}", "",
        "type Query {", "  zed: Zed_Response", "  alpha: Unknown", "}", "",
        "type Mutation {", "  add(thing: NewThing!, dry: Boolean): Add_Response", "}", "",
        "type Add_Response {", "  ok: Unknown", "}", "",
        "type Zed_Response {", "  b: Unknown", "  a(x: Int): Zed_Response_A", "  early: Unknown", "}", "",
        "type Zed_Response_A {", "  c: Unknown", "}", "",
        schema.INPUT_COMMENT, "input NewThing {", "  _placeholder: Unknown", "}", "",
    ]
    path = new_shared_path(spark, "sdl")
    schema.write_schema(df, path)
    assert [r.value for r in spark.read.text(path).collect() if r.value.startswith("type Z")] == [
        "type Zed_Response {", "type Zed_Response_A {",
    ]


def test_findings_without_operation_text_give_only_the_preamble(spark):
    df = found(spark, ("doc_id", "D", "doc_id: 1"))
    assert [r.line for r in schema.schema_lines(df).orderBy("line_no").collect()] == schema.PREAMBLE


def plain_selections(body):
    """(kind, path, name, alias) by a walk with a stack."""
    tokens_ = re.findall(r'"[^"]*"|\.\.\.|[$]?\w+|[{}():@]', body)
    stack, last, out, i, paren, started = [], None, [], 0, 0, False
    for i, t in enumerate(tokens_):
        after = tokens_[i + 1] if i + 1 < len(tokens_) else ""
        if t == "(":
            paren += 1
        elif t == ")":
            paren -= 1
        elif paren:
            if after == ":" and stack:
                out.append(("argument", tuple(stack[1:]), last, t))
        elif t == "{":
            stack.append(last if stack else "")
        elif t == "}":
            stack.pop()
        elif t == "...":
            last = ""
        elif stack and re.match("[A-Za-z_]", t) and after != ":":
            if tokens_[i - 1] in ("...", "@") or (tokens_[i - 1] == "on" and tokens_[i - 2] == "..."):
                continue
            out.append(("field", tuple(stack[1:]), t, tokens_[i - 2] if tokens_[i - 1] == ":" else None))
            last = t
    return sorted((k, p, n, a or "") for k, p, n, a in out if "" not in p and n != "")


def random_operation(rng, depth):
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.15:
            out.append("... on T { " + random_operation(rng, depth - 1) + " }" if depth else "...Bits")
            continue
        name = rng.choice("abcdef") + ("(x: 1, y: $v)" if kind > 0.8 else "")
        out.append(("z: " if kind > 0.9 else "") + name + (" { " + random_operation(rng, depth - 1) + " }" if depth and kind < 0.7 else ""))
    return " ".join(out)


def test_owners_equal_a_walk_with_a_stack(spark):
    rng = random.Random(6)
    bodies = ["query A { " + random_operation(rng, rng.randint(0, 6)) + " }" for _ in range(60)]
    df = typed(spark, *bodies)
    rows = tokens.selections(df).join(df.select("op_id", "body"), "op_id").collect()
    got = {body: [] for body in bodies}
    for r in rows:
        got[r.body].append((r.kind, tuple(r.path), r.name, r.alias or ""))
    for body in bodies:
        assert sorted(got[body]) == plain_selections(body), body


def test_owners_take_time_in_proportion_to_the_fields(spark):
    def seconds(n):
        body = "{ " + " ".join(f"f{i}(a: {i})" + (" { x y }" if i % 4 == 0 else "") for i in range(n // 2)) + " }"
        df = typed(spark, body)
        start = time.perf_counter()
        assert tokens.selections(df).count() == n // 2 * 2 + (n // 2 + 3) // 4 * 2
        return time.perf_counter() - start

    seconds(100)
    small = max(seconds(4_000), 1.0)
    assert seconds(32_000) < 10 * small


def test_texts_move_before_they_are_tokens(spark):
    df = spark.read.parquet(_stored(spark, typed(spark, "{ a { b } }")))
    plan = tokens.selections(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def _stored(spark, df):
    path = new_shared_path(spark, "bodies")
    df.write.parquet(path)
    return path
