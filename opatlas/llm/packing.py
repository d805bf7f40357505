"""Packing of tokenised documents into as few sequences of a fixed length as possible.

Every document is its token ids and one end id.  A longer one than a sequence is cut into whole
sequences; its first piece takes the rest.  Which lengths share a sequence is decided on the
histogram of piece lengths, which has one entry per length however many documents there are:

1. The covering linear program over configurations (how often each length occurs in a sequence)
   is solved by multiplicative weights: a knapsack over the lengths' prices, by dynamic
   programming, finds the best configurations; lengths they cover get cheaper.
2. Each step is rounded down to whole sequences as it is taken.
3. The few pieces left over are placed largest first, each sequence filled greedily, equal sequences
   at once.

The pieces then take their places by their rank among the pieces of their length; ranks are
counted in groups of bounded size.

A null text counts as empty: its document is the end id alone.  Repeated rows are packed each.
Extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opatlas.llm.tables import text_of, written

SEQUENCE = 1024
END = 2
ROUNDS, STEP, WEIGHT, NEAR = 400, 0.25, 1.0, 0.02
GROUP_ROWS = 200_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
# The vocabulary's files and its one special token.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"


class Encoder:
    """Token ids of texts.

    The rank file holds the vocabulary's merges, and its reader is several times faster; texts
    with the special token's string go to the vocabulary's own reader, which knows that token, and
    so do texts that the fast reader refuses: its pattern backtracks over long white space and
    gives up at about a million characters.
    """

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None) -> None:
        import public_tokenizers
        import tiktoken

        self.vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
        with open(ranks or public_tokenizers.path(RANKS), "rb") as file:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}
        )
        self.exact = None

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL not in text:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
            except ValueError:
                pass  # too much white space in one run
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.vocabulary)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")


@cache
def encoder_of(vocabulary: str | None, ranks: str | None) -> Encoder:
    """One encoder for each worker, whatever the number of its tasks."""
    return Encoder(vocabulary, ranks)


def cut(ids: np.ndarray, most: int = SEQUENCE) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of a document's pieces: only a longer document has several."""
    head = len(ids) % most or most
    bounds = [0, *range(min(head, len(ids)), len(ids), most), len(ids)]
    return [(a, ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]


def tokenised(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """A row for each piece of each document; ``ids_crc32`` is the checksum of its ids."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary, ranks)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encoder.ids(text.as_py()), np.uint32(END)).astype("<u4")
                for number, (start, own) in enumerate(cut(ids)):
                    out.append((doc_id, number, start, len(own), zlib.crc32(own.tobytes())))
                if len(out) >= 10_000:
                    yield _pieces(out)
                    out = []
            yield _pieces(out)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(
        encoded, PIECES
    )


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


Configuration = tuple[tuple[int, int], ...]  # (length, how often), longest first


def best_values(lengths: np.ndarray, prices: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Highest total price that fits into each room up to ``size``, by dynamic programming.

    (values, choices): a choice is the place of a length to put into that room, -1 for leaving one
    token of it empty.
    """
    value, choice = np.zeros(size + 1), np.full(size + 1, -1)
    fits = np.searchsorted(lengths, np.arange(size + 1), "right")
    for room in range(1, size + 1):
        value[room] = value[room - 1]
        if fits[room]:
            with_each = value[room - lengths[: fits[room]]] + prices[: fits[room]]
            best = int(with_each.argmax())
            if with_each[best] > value[room] + 1e-15:
                value[room], choice[room] = with_each[best], best
    return value, choice


def filled(lengths: np.ndarray, choice: np.ndarray, room: int, start: int | None = None) -> Configuration:
    """The best configuration of ``room``, beside one piece of the length at place ``start``."""
    counts: dict[int, int] = {}
    if start is not None:
        counts[int(lengths[start])] = 1
    while room > 0:
        if choice[room] < 0:
            room -= 1
            continue
        length = int(lengths[choice[room]])
        counts[length] = counts.get(length, 0) + 1
        room -= length
    return tuple(sorted(counts.items(), reverse=True))


def best_configuration(lengths: np.ndarray, prices: np.ndarray, size: int) -> Configuration:
    """The configuration of the highest total price that fits."""
    return filled(lengths, best_values(lengths, prices, size)[1], size)


def program(histogram: dict[int, int], size: int, rounds: int = ROUNDS) -> list[tuple[Configuration, int]]:
    """Configurations and in how many sequences to use them, by multiplicative weights.

    A length's price is its share of a sequence, times a weight that falls exponentially with the share
    of its pieces that is covered, so lengths left behind become dear.  A round prices all configurations
    by one dynamic program, which holds the best one around each length.  Those whose price comes within
    ``NEAR`` of the best are used, lengths left behind first, ``STEP`` of what each still allows at a time
    and rounded down to whole sequences; so no length is exceeded and nothing is lost by rounding later.
    Rounds go on while they place anything.  The dynamic program doesn't know how many pieces are left, so
    lengths of one or two pieces each stay for the last step.
    """
    lengths = np.array(sorted(histogram))
    wanted = np.array([histogram[n] for n in lengths], float)
    left = wanted.copy()
    place = {int(n): i for i, n in enumerate(lengths)}
    used: dict[Configuration, int] = {}
    for _ in range(rounds):
        alive = np.flatnonzero(left > 0)
        if not len(alive):
            break
        share = left / wanted
        prices = lengths / size * np.exp(WEIGHT * (share - share.max()))
        own = lengths[alive]
        value, choice = best_values(own, prices[alive], size)
        placed = False
        for i in np.argsort(-share[alive], kind="stable"):
            j = alive[i]
            if left[j] < 1 or prices[j] + value[size - lengths[j]] < (1 - NEAR) * value[size]:
                continue
            found = filled(own, choice, size - int(lengths[j]), int(i))
            at = [place[n] for n, _ in found]
            often = np.array([c for _, c in found], float)
            most = float((left[at] / often).min())
            times = max(int(most * STEP), int(most >= 1))
            if times:
                left[at] -= times * often
                used[found] = used.get(found, 0) + times
                placed = True
        if not placed:
            break
    return list(used.items())


def plan(histogram: dict[int, int], size: int = SEQUENCE, rounds: int = ROUNDS) -> list[tuple[Configuration, int]]:
    """(configuration, number of sequences) that hold exactly the histogram's pieces."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out: list[tuple[Configuration, int]] = []
    if size in left:
        out.append((((size, 1),), left.pop(size)))
    if not left:
        return out
    for found, times in program(left, size, rounds):
        out.append((found, times))
        for n, c in found:
            left[n] -= c * times
    while left := {n: c for n, c in left.items() if c > 0}:
        found = _fullest(left, size)
        times = min(left[n] // c for n, c in found)
        out.append((found, times))
        for n, c in found:
            left[n] -= c * times
    return out


def _fullest(left: dict[int, int], size: int) -> Configuration:
    """The longest piece left, and the pieces that fill its sequence best."""
    lengths = sorted(left, reverse=True)
    head = lengths[0]
    room = size - head
    # reach[r]: the last length of some set of pieces that sums to r, and how often it is used
    reach: dict[int, tuple[int, int]] = {0: (0, 0)}
    for n in lengths:
        if n > room or room in reach:
            continue
        available = left[n] - (n == head)
        for base in list(reach):
            total, k = base + n, 1
            while k <= available and total <= room and total not in reach:
                reach[total] = (n, k)
                total, k = total + n, k + 1
    best = max(reach)
    counts = {head: 1}
    while best:
        n, k = reach[best]
        counts[n] = counts.get(n, 0) + k
        best -= n * k
    return tuple(sorted(counts.items(), reverse=True))


def pack(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """``pieces`` (``written``, with a length each) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    entries, base = [], 0
    next_rank = dict.fromkeys(histogram, 0)
    for found, times in plan(histogram, size):
        at = 0
        for n, c in found:
            entries.append((n, next_rank[n], next_rank[n] + c * times, c, base, at))
            next_rank[n] += c * times
            at += n * c
        base += times
    layout = spark.createDataFrame(
        entries, "of_length bigint, low bigint, high bigint, often bigint, base bigint, at bigint"
    )
    groups = max(1, -(-sum(histogram.values()) // GROUP_ROWS))
    # by the place a piece is read at, so that pieces of repeated or missing ids spread, too
    placed = pieces.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    counts = placed.groupBy("length", "part").agg(F.count("*").alias("own"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("length").alias("of_length"), F.col("part").alias("of_part"),
        F.coalesce(F.sum("own").over(before), F.lit(0)).alias("ahead"),
    )
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = placed.withColumn("rank", F.row_number().over(within) - 1)
    ranked = ranked.join(
        starts, (F.col("length") == F.col("of_length")) & (F.col("part") == F.col("of_part"))
    ).withColumn("rank", F.col("rank") + F.col("ahead")).drop("of_length", "of_part", "ahead", "part")
    # at most a few entries for each configuration, and their number doesn't depend on the rows
    found = ranked.join(
        F.broadcast(layout),
        (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
    )
    place = F.col("rank") - F.col("low")
    return found.select(
        *pieces.columns,
        (F.col("base") + F.floor(place / F.col("often"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + F.pmod(place, F.col("often")) * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame) -> DataFrame:
    """Every piece of every document, and its place in a sequence."""
    return pack(written(tokenised(docs), "pieces"))
