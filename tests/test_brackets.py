from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from opatlas import fixed_values as V
from opatlas.functions import brackets as B
from opatlas.functions import text as T
from opatlas.functions.columns import all_matches, let
from opatlas.functions.patterns import balanced
from opatlas.operators.constants import chain_links, conditional_values
from opatlas.operators.variables import headers, variables_in


def apply(spark, function, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.t for r in df.select("i", function(F.col("t")).alias("t")).orderBy("i").collect()]


def plain_pairs(text):
    stack, found = [], {}
    for i, c in enumerate(text):
        if c == "(":
            stack.append(i)
            found[i] = None
        elif c == ")":
            found[i] = stack.pop() if stack else None
            if found[i] is not None:
                found[found[i]] = i
    return sorted(found.items())


def test_pairs_are_the_stack_s(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("()x") for _ in range(rng.randint(0, 80))) for _ in range(80)]
    texts += ["(" * 1000 + ")" * 1000, ")" * 50 + "(" * 50, ""]

    def pairs(text):
        return let(all_matches(text, "[()]|[^()]"), lambda t: B.pairs(B.steps_of(t, "(", ")")))

    for text, found in zip(texts, apply(spark, pairs, *texts), strict=True):
        assert [(p.place, p.partner) for p in found] == plain_pairs(text), text


def plain_flatten(text):
    out, i = [], 0
    while (start := text.find(".concat(", i)) >= 0:
        out.append(text[i:start])
        depth, end = 1, start + 8
        while end < len(text) and depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        if end == start + 8:
            out.append(".concat(")
        out += re.findall(r'"((?:[^"\\]|\\[\s\S])+)"', text[start + 8 : end - 1])
        i = end
    return "".join([*out, text[i:]])


@pytest.mark.parametrize("seed", range(5))
def test_flatten_equals_the_walk(spark, seed):
    rng = random.Random(seed)
    bits = [".concat(", "(", ")", ")", '"a"', '"(b"', "x", " ", '"', "\\"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(100)]
    assert apply(spark, T.flatten_concat, *texts) == [plain_flatten(t) for t in texts]


@pytest.mark.parametrize("levels", [70, 1000, 20_000])
def test_calls_of_any_depth(spark, levels):
    text = 'q { a ".concat(' + "(" * levels + '"kept"' + ")" * levels + ').concat("too") }'
    assert apply(spark, T.flatten_concat, text) == ['q { a "kepttoo }']


def test_many_calls_take_linear_time(spark):
    def seconds(n):
        text = '"a".concat(f("b", (c)))' * n
        start = time.perf_counter()
        assert apply(spark, lambda t: F.length(T.flatten_concat(t)), text) == [4 * n]
        return time.perf_counter() - start

    seconds(10)
    assert seconds(80_000) < 12 * max(seconds(10_000), 0.2)


def plain_blocks(text):
    """Each operation head and its block, or the text up to the next head."""
    heads = list(re.finditer(r"\b(?:query|mutation)\s+[A-Za-z_]\w*\s*(?:\([^)]*\))?\s*(?=\{)", text))
    out = []
    for k, head in enumerate(heads):
        depth, end = 0, None
        for i in range(head.end(), len(text)):
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            if depth == 0:
                end = i + 1
                break
        stop = end or (heads[k + 1].start() if k + 1 < len(heads) else len(text))
        out.append(text[head.start() : stop])
    return out


@pytest.mark.parametrize("levels", [1, 2, 16])
def test_blocks_equal_the_walk(spark, levels):
    rng = random.Random(levels)
    bits = [" query A ", "{", "}", "}", " mutation B($x: In = {a: 1}) ", "{ f", "x", " query "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(200)]

    def blocks(text):
        return B.blocks_behind(text, V.OPERATION_HEAD, r"\{", balanced("{", "}", levels))

    assert apply(spark, blocks, *texts) == [plain_blocks(t) for t in texts]


def test_braces_are_counted_on_the_exact_way_only(spark):
    """Texts whose blocks all close take no count of the text between two heads."""
    df = spark.createDataFrame([("query A { a } " + "x" * 100,)], "t string")
    found = df.select(B.blocks_behind(F.col("t"), V.OPERATION_HEAD, r"\{", balanced("{", "}", 2)).alias("found"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.first().found == ["query A { a }"]
    assert "translate(" not in plan and V.OPERATION_INITIAL in plan


def test_nested_and_unclosed_heads_take_linear_time(spark):
    """Up to a megabyte of heads, each inside of the one before it, and heads that never close."""

    def seconds(text, want):
        def total(t):
            return F.size(B.blocks_behind(t, V.OPERATION_HEAD, r"\{", balanced("{", "}", 16)))

        start = time.perf_counter()
        assert apply(spark, total, text) == [want]
        return time.perf_counter() - start

    for unit in ("query Q%d { a { b ", "query Q%d { a { b } "):
        small, large = ("".join(unit % i for i in range(n)) for n in (6_000, 48_000))
        seconds(small, 6_000)
        assert seconds(large, 48_000) < 14 * max(seconds(small, 6_000), 0.3)
    deep = "query Deep {" + "a{" * 250_000 + "x" + "}" * 250_000 + "} tail"
    assert apply(spark, lambda t: F.transform(B.blocks_behind(t, V.OPERATION_HEAD, r"\{", balanced("{", "}", 16)), F.length), deep) == [
        [len(deep) - 5]
    ]


@pytest.mark.parametrize("levels", [2, 70, 1000])
def test_variable_headers_of_any_depth(spark, levels):
    default = "(" * levels + '")($no: X"' + ")" * levels
    body = f"query A($f: Filter = {default}, $n: Int @d(a: [{default}])) {{ a(x: $f) }} mutation ($m: In) {{ b }} query Open($x: Int"

    def found(text):
        return F.transform(headers(text), lambda h: F.struct(h["operation_type"], h["operation_name"], variables_in(h["block"])["variable"].alias("v")))

    (rows,) = apply(spark, found, body)
    assert [tuple(r) for r in rows] == [("query", "A", ["f", "n"]), ("mutation", "", ["m"])]


@pytest.mark.parametrize("levels", [0, 1, 70, 1000])
def test_conditionals_of_any_depth(spark, levels):
    def values(text):
        return conditional_values(text)

    condition = "f(" + "[(" * levels + '"?:)"' + ")]" * levels + ")"
    assert apply(
        spark, values, f"{condition}?a:b", f'{condition} ? g("x:y") : "c?d:e"', f"{condition}?", "a", "a[x?1:2]", 'u(1)?v?a:b:c', "a)?b:c"
    ) == [["a", "b"], [' g("x:y") ', ' "c?d:e"'], None, None, None, ["v?a", "b:c"], None]


@pytest.mark.parametrize("levels", [3, 70, 1000])
def test_chains_of_any_depth(spark, levels):
    nested = "n(" + "(" * levels + "x" + ")" * levels + ")"
    body = (
        f'var w=" {{ made {{ id }} }}";r("query Made".concat({nested}?w:"").concat(" "),"none".concat(w).concat(w));'
        f'z("query Open".concat(w)' + ".concat(" + "(" * levels
    )
    bundles = spark.createDataFrame([("b", body)], "bundle_id string, body string")
    links = [tuple(r)[1:] for r in chain_links(bundles).orderBy("chain_no", "link_no").collect()]
    assert links == [(0, "query Made", 0, f'{nested}?w:""'), (0, "query Made", 1, '" "'), (2, "query Open", 0, "w")]


def test_a_run_of_brackets_around_a_call_costs_no_more_than_its_text(spark):
    """Brackets that belong to no call are neither paired nor sorted, so a deep call is cheap."""
    deep = 'q{ a ".concat(' + "(" * 4000 + '" kept "' + ")" * 4000 + ').concat(" }") + (b.concat("c"))).concat('
    df = spark.range(1500).select(F.concat(F.lit(deep), F.col("id").cast("string")).alias("t")).localCheckpoint()
    begun = time.monotonic()
    got = df.select(T.flatten_concat(F.col("t")).alias("t")).distinct().count()
    assert got >= 1 and time.monotonic() - begun < 12
    assert apply(spark, T.flatten_concat, deep) == [plain_flatten(deep)]


def test_runs_close_calls_of_many_levels(spark):
    nested = 'a.concat("b", ' * 40 + "x" + ")" * 40 + ').concat("c"))) d.concat((e)) ))' + "((.concat(f" * 30 + ")" * 50
    texts = [nested, ")" * 20 + nested, 'a.concat("b"', ".concat(", "a.concat(b.concat(", 'a..concat("b").concat.concat()']
    assert apply(spark, T.flatten_concat, *texts) == [plain_flatten(t) for t in texts]
