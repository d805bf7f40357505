"""Text functions against brute force on random texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from opatlas import fixed_values as V
from opatlas.functions import brackets as B
from opatlas.functions import text as T
from opatlas.functions.patterns import BLOCK_LEVELS, balanced
from opatlas.operators import constants, tokens
from opatlas.session import materialize, new_shared_path, shared_dir


def random_texts(alphabet, n=400, size=24, seed=3):
    random.seed(seed)
    return ["".join(random.choice(alphabet) for _ in range(random.randrange(size))) for _ in range(n)]


def apply(spark, function, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.t for r in df.select("i", function(F.col("t")).alias("t")).orderBy("i").collect()]


def depths(text):
    depth, result = 0, []
    for c in text:
        depth += (c == "{") - (c == "}")
        result.append(depth)
    return result


def test_balance(spark):
    texts = random_texts("{}{}ab")
    want = ["{" in t and min(depths(t)) >= 0 and depths(t)[-1] == 0 for t in texts]
    assert apply(spark, T.is_balanced, texts) == want


@pytest.mark.parametrize("simple", [balanced("{", "}", BLOCK_LEVELS), balanced("{", "}", 1)])
def test_cut_at_closing_brace(spark, simple):
    texts = ["{" + t for t in random_texts("{}{}ab")]

    def cut(text):
        d = depths(text)
        return text[: d.index(0) + 1] if 0 in d else text

    def blocks(text):
        return B.blocks_behind(F.concat(F.lit("x query A "), text), V.OPERATION_HEAD, r"\{", simple)

    assert apply(spark, blocks, texts) == [["query A " + cut(t)] for t in texts]


def test_balanced_pattern_agrees_with_the_walk(spark):
    texts = ["{" + t for t in random_texts("{}{}ab", size=16)]
    pattern = balanced("{", "}", BLOCK_LEVELS)
    got = apply(spark, lambda t: F.regexp_extract(t, "^" + pattern, 0), texts)
    assert got == [t[: depths(t).index(0) + 1] if 0 in depths(t) else "" for t in texts]


def test_flatten_concat(spark):
    def flat(text):
        out, i = "", 0
        while True:
            start = text.find(".concat(", i)
            if start < 0 or start + 8 == len(text):
                return out + text[i:]
            out += text[i:start]
            end, depth = start + 8, 1
            while end < len(text) and depth:
                depth += (text[end] == "(") - (text[end] == ")")
                end += 1
            # A literal has at least one character; texts here hold no escapes.
            position, quoted = 0, []
            arguments = text[start + 8 : end - 1]
            while True:
                opening = arguments.find('"', position)
                closing = arguments.find('"', opening + 1) if opening >= 0 else -1
                if opening < 0 or closing < 0:
                    break
                if closing == opening + 1:
                    position = opening + 1
                    continue
                quoted.append(arguments[opening + 1 : closing])
                position = closing + 1
            out += "".join(quoted)
            i = end

    random.seed(8)
    pieces = [".concat(", '"', "(", ")", "a", " ", ")"]
    texts = ["".join(random.choice(pieces) for _ in range(random.randrange(14))) for _ in range(500)]
    assert apply(spark, T.flatten_concat, texts) == [flat(t) for t in texts]


def test_conditional_split(spark):
    def split(text):
        def find(mark, start):
            depth, i = 0, start
            while i < len(text):
                c = text[i]
                if c in "([":
                    depth += 1
                elif c in ")]":
                    depth -= 1
                elif c == '"':
                    i += 1
                    while i < len(text) and text[i] != '"':
                        i += 1
                elif c == mark and depth == 0:
                    return i
                i += 1
            return -1

        question = find("?", 0)
        colon = find(":", question + 1) if question >= 0 else -1
        return None if colon < 0 else (text[question + 1 : colon], text[colon + 1 :])

    random.seed(4)
    pieces = ["?", ":", "(x)", "[y]", "(a?b:c)", '"q?"', "f", " ", "(", ")", "[", '"']
    texts = ["".join(random.choice(pieces) for _ in range(random.randrange(9))) for _ in range(800)]
    got = [v and tuple(v) for v in apply(spark, constants.conditional_values, texts)]
    assert got == [split(t) for t in texts]


def test_balanced_operations_close_at_depth_zero(spark):
    random.seed(2)

    def block(depth):
        return "{ " + " ".join(
            f"f{i}" + (" " + block(depth - 1) if depth and random.random() < 0.5 else "") for i in range(3)
        ) + " }"

    bodies = [f"query Q{i} {block(random.randrange(6))}" for i in range(40)]
    df = spark.createDataFrame([("query", b) for b in bodies], "operation_type string, operation_body string")
    df = df.withColumns({"first_order": F.lit(0).cast("decimal(38,0)"), "first_ord": F.lit(0)})
    rows = {r.op_id: r for r in tokens.structure_report(df).collect()}
    assert len(rows) == len(bodies)
    assert {r.closing_depth for r in rows.values()} == {0}
    assert sorted(r.max_depth for r in rows.values()) == sorted(max(depths(b)) for b in bodies)
    assert sum(r.n_fields for r in rows.values()) == sum(b.count("f") for b in bodies)


class FakeContext:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = f"{folder}/application"


class FakeSession:
    def __init__(self, context, settings):
        self.sparkContext, self.conf = context, settings


def test_shared_folder_is_the_one_the_session_names():
    session = FakeSession(FakeContext("spark://host:7077"), {"spark.checkpoint.dir": "hdfs://shared/"})
    assert shared_dir(session) == "hdfs://shared"
    assert session.sparkContext.folder == "hdfs://shared//application"
    assert new_shared_path(session, "x").startswith("hdfs://shared/x-")


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(FakeSession(FakeContext("spark://host:7077"), {}))


def test_kept_tables_are_files_in_the_shared_folder(spark):
    kept = materialize(spark.range(3))
    assert kept.count() == 3
    assert shared_dir(spark).split(":")[-1] in kept.inputFiles()[0]
