"""Reproducible shuffle of a table's rows into shards.

Rows get global numbers by their order, a permutation of the numbers gives each row its position in
the shuffle, and the position alone gives shard and slot: counts of shards differ by one at most.
Seed and number of rows fix the permutation, so shard and slot of any row number can be computed
without the table, and so can the row number of any slot.

* Global numbers: rows are range-partitioned in their order, each remembers its partition and place,
  and running sizes of the partitions turn places into numbers.  Rows that are equal in all ordered
  columns are told apart by where they were read, so one row repeated any number of times spreads
  over partitions; which of its copies gets which number makes no difference.
* Permutation: a Feistel network of alternating modular additions over the smallest near-square grid
  that holds all numbers.  Up to about sqrt(n) cells of the grid lie beyond the last number; a number
  that the network sends there goes through it again until it comes back (cycle walking).  How often
  at most is found on those cells alone, by Spark, so the expression walks that far and no number is
  left outside.

All of it is DataFrame functions.  A null text has size 8 and the checksum of an empty one; null ids
come first.  Extra columns don't matter for :func:`shard_digest`; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opatlas.functions.columns import let
from opatlas.llm.tables import text_of, written

SHARDS, SEED, ROUNDS = 24, 20_240_607, 8
ROW_BYTES = 8
# Fixed value: monotonically_increasing_id() has the place within a partition in its low 33 bits.
PLACE_BITS = 33


@dataclass(frozen=True)
class Permutation:
    """A permutation of 0 .. n-1 as a Column expression, and its inverse."""

    n: int
    seed: int
    steps: int = 0  # further passes that the longest walk beyond n takes

    @property
    def sides(self) -> tuple[int, int]:
        rows = math.isqrt(max(self.n - 1, 0)) + 1
        return rows, max(1, -(-self.n // rows))

    def _added(self, half: Column, number: Column) -> Column:
        return F.xxhash64(half, number, F.lit(self.seed).cast("bigint"))

    def once(self, number: Column, backwards: bool = False) -> Column:
        """One pass of the network: a bijection of the whole grid.

        A round turns (left, right) into (right, left + f(right)), so the halves change their sides
        and an even number of rounds gives them back.
        """
        rows, columns = self.sides
        order = reversed(range(ROUNDS)) if backwards else range(ROUNDS)
        rounds = F.array(
            *[F.struct(F.lit(i).alias("number"), F.lit((rows, columns)[i % 2]).cast("bigint").alias("side")) for i in order]
        )
        width = F.lit(columns).cast("bigint")
        start = F.struct(F.call_function("div", number, width).alias("left"), F.pmod(number, width).alias("right"))

        def forth(state: Column, one: Column) -> Column:
            moved = F.pmod(state["left"] + F.pmod(self._added(state["right"], one["number"]), one["side"]), one["side"])
            return F.struct(state["right"].alias("left"), moved.alias("right"))

        def back(state: Column, one: Column) -> Column:
            moved = F.pmod(state["right"] - F.pmod(self._added(state["left"], one["number"]), one["side"]), one["side"])
            return F.struct(moved.alias("left"), state["left"].alias("right"))

        return F.aggregate(rounds, start, back if backwards else forth, lambda s: s["left"] * width + s["right"])

    def _walked(self, number: Column, backwards: bool) -> Column:
        reached = self.once(number, backwards)
        for _ in range(self.steps):
            reached = let(reached, lambda x: F.when(x >= self.n, self.once(x, backwards)).otherwise(x))
        return reached

    def position(self, number: Column) -> Column:
        return self._walked(number, False)

    def number(self, position: Column) -> Column:
        return self._walked(position, True)


def permutation(spark: SparkSession, n: int, seed: int = SEED) -> Permutation:
    """The permutation of n numbers, with the length of its longest walk beyond them."""
    plain = Permutation(n, seed)
    rows, columns = plain.sides
    cell = F.col("id")
    # the cells beyond n that some number is sent to; walks from them come back, so this ends
    beyond = spark.range(n, rows * columns).where(plain.once(cell, backwards=True) < n)
    steps = 0
    while n and not beyond.isEmpty():
        beyond = beyond.select(plain.once(cell).alias("id")).where(cell >= n)
        steps += 1
    return Permutation(n, seed, steps)


def numbered(rows: DataFrame, order: list[str], number: str) -> DataFrame:
    """``rows``, ``written`` already, with their numbers from 0 in this order as a further column."""
    read_at, place = f"{number}_read_at", f"{number}_place"
    marked = rows.withColumn(read_at, F.monotonically_increasing_id())
    dealt = marked.repartitionByRange(*order, read_at).sortWithinPartitions(*order, read_at)
    placed = written(dealt.withColumn(place, F.monotonically_increasing_id()).drop(read_at), "numbered")
    part = F.shiftright(place, PLACE_BITS)
    sizes = placed.groupBy(part.alias("of_part")).agg(F.count("*").alias("own"))
    before = Window.orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    ahead = sizes.select("of_part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("ahead"))
    found = placed.join(F.broadcast(ahead), part == F.col("of_part"))
    at = F.col(place).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return found.select(*rows.columns, (F.col("ahead") + at).alias(number))


def sharded(rows: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with their ``shard`` and ``slot`` in a shuffle; slots of a shard run from 0 without a gap.

    ``order`` fixes the rows' numbers.  Every column of ``rows`` moves once; give only what is needed.
    """
    taken = {c.lower() for c in rows.columns} & {"shard", "slot", "row_number", "of_part", "own", "ahead"}
    if taken:
        raise ValueError(f"the table has columns of these names already: {sorted(taken)}")
    kept = written(rows, "to_shard")
    order_of = permutation(rows.sparkSession, kept.count(), seed)
    position = order_of.position(F.col("row_number"))
    placed = numbered(kept, order, "row_number").withColumn("row_number", position)
    return placed.select(
        *rows.columns,
        F.pmod("row_number", F.lit(shards)).cast("int").alias("shard"),
        F.call_function("div", F.col("row_number"), F.lit(shards)).cast("bigint").alias("slot"),
    )


def shard_digest(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Shard and slot of every document, with the size and checksum of its text; texts don't move."""
    text = text_of().cast("binary")
    slim = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return sharded(slim, ["doc_id", "size", "text_crc32"], shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
