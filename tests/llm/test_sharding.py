from __future__ import annotations

import struct
import zlib

import cases
import pytest
import xxhash

pytest.importorskip("opatlas.llm")
from opatlas.llm import sharding  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def plain_network(number, n, seed):
    """The network on one number, with the hash computed outside of Spark."""
    rows, columns = sharding.Permutation(n, seed).sides
    left, right = divmod(number, columns)
    for i in range(sharding.ROUNDS):
        h = xxhash.xxh64_intdigest(struct.pack("<q", right), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", i), h)
        h = xxhash.xxh64_intdigest(struct.pack("<q", seed), h)
        side = (rows, columns)[i % 2]
        signed = h - (1 << 64) if h >> 63 else h
        left, right = right, (left + signed % side) % side
    return left * columns + right


def plain_positions(n, seed):
    out = []
    for number in range(n):
        x = plain_network(number, n, seed)
        while x >= n:
            x = plain_network(x, n, seed)
        out.append(x)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 50, 227, 1000])
@pytest.mark.parametrize("seed", [1, 2])
def test_permutation_equals_the_plain_one(spark, n, seed):
    found = sharding.permutation(spark, n, seed)
    rows = spark.range(n).select("id", found.position(F.col("id")).alias("at"))
    rows = rows.select("id", "at", found.number(F.col("at")).alias("back")).orderBy("id").collect()
    assert [r.at for r in rows] == plain_positions(n, seed)
    assert sorted(r.at for r in rows) == list(range(n))
    assert all(r.back == r.id for r in rows)


def test_some_numbers_walk(spark):
    assert max(sharding.permutation(spark, n, 3).steps for n in (5, 11, 37, 226, 901)) >= 2


def test_grids_hold_all_numbers():
    for n in [1, 2, 3, 10**6, 10**6 + 1, 10**12 + 7, 2**40 - 1]:
        rows, columns = sharding.Permutation(n, 0).sides
        assert n <= rows * columns <= n + rows


def digest(spark, rows, clashing=False):
    got = sharding.shard_digest(cases.frame(spark, rows, clashing)).collect()
    return sorted(map(tuple, got), key=lambda r: (r[0] is not None, r))


def test_documents_are_dealt_evenly_and_reproducibly(spark):
    rows = cases.documents() + [(77, "copy", "en", "s", 4)] * 90
    got = digest(spark, rows)
    order = sorted(
        ((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]),
    )
    positions = plain_positions(len(rows), sharding.SEED)
    want = [(*row, "rows", at % 24, at // 24, None) for row, at in zip(order, positions, strict=True)]
    assert got == sorted(want, key=lambda r: (r[0] is not None, r))
    counts = [sum(r[4] == s for r in got) for s in range(24)]
    assert max(counts) - min(counts) <= 1
    for s in range(24):
        assert sorted(r[5] for r in got if r[4] == s) == list(range(counts[s]))
    # neither the order of the rows nor further columns nor partitions change anything
    assert digest(spark, rows[::-1], clashing=True) == got


def test_whole_rows_can_be_dealt(spark):
    docs = cases.frame(spark, cases.documents())
    got = sharding.sharded(docs, ["doc_id", "text"], shards=5)
    assert got.columns == [*docs.columns, "shard", "slot"]
    assert got.select(docs.columns).exceptAll(docs).isEmpty() and got.count() == docs.count()
    with pytest.raises(ValueError, match="slot"):
        sharding.sharded(docs.withColumn("Slot", F.lit(1)), ["doc_id"])


def test_few_rows_and_none(spark):
    assert digest(spark, []) == []
    got = digest(spark, [(1, "a", None, None, None), (None, None, None, None, None)])
    assert sorted(r[4] for r in got) == [0, 1] and {r[5] for r in got} == {0}


def test_no_python_workers(spark):
    plan = sharding.shard_digest(cases.frame(spark, cases.documents()[:20]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
