"""Documents whose sets of word n-grams overlap: an exact Jaccard self-join.

The join is the product of the document by n-gram incidence matrix with its transpose, taken in
blocks; overlap counts accumulate inside a block, and pairs whose sizes rule them out are dropped.

1. Documents with equal sets are one node.  A node is numbered by a 64-bit hash of its set; with N
   different sets, about N**2 / 2**65 pairs of them share a number by chance.
2. Nodes meet in families: all nodes that share one of three min-hashes.  A family's block of the
   product is computed whole, tiles of ``TILE`` rows against at most ``BLOCK`` others, so every
   link inside a family is found.  A task returns a spanning forest of the links, never all pairs.
3. Links between nodes that meet in no family are found by an exact prefix filter: two sets of
   the wanted similarity share one of their first n - ceil(n * similarity) + 1 n-grams in any
   fixed order.  The order puts n-grams seen often last.  The product of this smaller matrix
   accumulates how many of them a pair shares in short columns; at most the smaller number of either
   one's entries in long columns comes on top, and pairs that share too few for their sizes are
   discarded.  One shared n-gram has to be the first one: nothing before it is shared then, so what
   is left of either set behind it bounds the overlap.  Long columns list only pairs for which theirs
   may be the first, so texts that share a common passage but begin with n-grams of their own are
   never listed there.  Pairs already connected, or met in a family, are discarded as well.
4. The remaining candidates are checked: the overlap of their whole sets is counted, and all links
   are contracted to components.

The result is the same whatever the families, the order and the block sizes are.

A text without words (null, empty, white space only) has no set and is linked with nothing.
Rows repeated in the table are documents of one node.  A row whose id is null belongs to its
node but never names a component; a component of such rows only has a null id.  Extra columns
don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opatlas.llm.components import components
from opatlas.llm.runs import by_key, joined, runs
from opatlas.llm.tables import free_name, most_frequent, written
from opatlas.llm.word_arrays import Texts, mixed, parts, shingles

WORDS = 5
SIMILARITY = (4, 5)  # at least 4 / 5
TILE, BLOCK = 512, 2048
# A column of the prefix matrix with more nodes than this is compared by component.
SHORT_COLUMN = 16
# N-grams put last in the order: the most frequent ones, as seen by single tasks.
FREQUENT = 1 << 17
SEEN_OFTEN = 4
SEEN_BUFFER = 4 << 20
FILTER_BITS = 24
_SEEDS = np.array([0xD1342543DE82EF95, 0xAF251AF3B0F025B5], np.uint64)

KEYS = ["key1", "key2", "key3"]
ROWS = "doc_id bigint, n bigint, node bigint, key1 bigint, key2 bigint, key3 bigint, gram bigint, seen bigint"


def text_sets(texts: Texts, size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; the whole text is one where it is shorter."""
    words = texts.words()
    hashes = words.hashes()
    every = shingles(hashes, size) if len(hashes) >= size else None
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        own = every[a : b - size + 1] if b - a >= size else shingles(hashes[a:b], size)
        own = np.sort(own)
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        out.append(own)
    return out


def node_of(own: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        total = np.add.reduce(mixed(own + np.uint64(1)), dtype=np.uint64)
        return mixed(np.array([total + np.uint64(len(own))]))[0]


def keys_of(own: np.ndarray) -> tuple[np.uint64, ...]:
    """Min-hashes of a set, one for each of ``KEYS``."""
    return own[0], *(mixed(own ^ seed).min() for seed in _SEEDS)


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64), pa.int64())


def _repeated(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values, counts = np.unique(np.concatenate(grams), return_counts=True)
    often = counts >= SEEN_OFTEN
    return values[often], counts[often]


def _described(docs: DataFrame) -> DataFrame:
    """A row for each document, and one for each n-gram that a task has seen often."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "node", *KEYS, "gram", "seen"]
        kept: list[np.ndarray] = []
        size = 0

        def often() -> pa.RecordBatch:
            values, counts = _repeated(kept)
            none = pa.nulls(len(values), pa.int64())
            return pa.RecordBatch.from_arrays(
                [none] * (3 + len(KEYS)) + [_signed(values), pa.array(counts, pa.int64())], names
            )

        for batch in batches:
            for begin, stop, part in parts(batch.column("text")):
                sets = text_sets(part)
                some = np.array([len(s) > 0 for s in sets])
                keys = [keys_of(s) if len(s) else (0,) * len(KEYS) for s in sets]

                def or_null(values, some=some) -> pa.Array:
                    numbers = np.asarray(values, np.uint64).view(np.int64)
                    return pa.array(numbers, pa.int64(), mask=~some)

                n = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(begin, n).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        or_null([node_of(s) for s in sets]),
                        *(or_null([k[i] for k in keys]) for i in range(len(KEYS))),
                        pa.nulls(n, pa.int64()),
                        pa.nulls(n, pa.int64()),
                    ],
                    names,
                )
                kept += sets
                size += sum(map(len, sets))
                if size > SEEN_BUFFER:
                    yield often()
                    kept, size = [], 0
        if kept:
            yield often()

    return docs.select("doc_id", "text").mapInArrow(described, ROWS)


class NumberFilter:
    """Bits of the numbers in a column: a fixed-size test that lets every one of them pass."""

    def __init__(self, numbers: DataFrame) -> None:
        (name,) = numbers.columns
        place = F.pmod(F.col(name), F.lit(1 << FILTER_BITS)) + 1
        found = (
            numbers.select(place.alias("place"))
            .groupBy(F.bitmap_bucket_number("place").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
            .collect()  # at most 2**FILTER_BITS bits in all
        )
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for row in found:
            begin = (row["bucket"] - 1) * 4096
            bits[begin : begin + 4096] = np.frombuffer(row["bits"], np.uint8)
        self.shared = numbers.sparkSession.sparkContext.broadcast(bits.tobytes())

    def has(self, numbers: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(self.shared.value, np.uint8)
        place = (numbers & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
        return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _required(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least overlap of linked sets of n and m n-grams."""
    top, bottom = SIMILARITY
    return -(-top * (n + m) // (top + bottom))


def _sizes_allow(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    top, bottom = SIMILARITY
    return bottom * np.minimum(n, m) >= top * np.maximum(n, m)


def _may_be_first(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the first n-gram that linked sets share can stand at places i and j of their orders.

    Sets that share nothing before share at most what is left of the shorter rest.
    """
    return np.minimum(n - i, m - j) >= _required(n, m)


class _Forest:
    """Union-find over places 0..n-1."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in range(len(self.parent)) if (r := self.root(x)) != x]


def product_links(rows: list[np.ndarray], others: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in ``rows``, in ``others``) of linked pairs, tile by tile of the product."""
    size_b = np.array([len(s) for s in others])
    columns, code = np.unique(np.concatenate(others), return_inverse=True)
    owner = np.repeat(np.arange(len(others)), size_b)
    by_column = np.argsort(code, kind="stable")
    owner, counts = owner[by_column], np.bincount(code)
    starts = np.cumsum(counts) - counts
    dense_from = 32
    dense = np.flatnonzero(counts > dense_from)
    number = np.full(len(columns), -1)
    number[dense] = np.arange(len(dense))
    for begin in range(0, len(rows), TILE):
        tile = rows[begin : begin + TILE]
        size_a = np.array([len(s) for s in tile])
        grams, who = np.concatenate(tile), np.repeat(np.arange(len(tile)), size_a)
        at = np.minimum(np.searchsorted(columns, grams), len(columns) - 1)
        hit = columns[at] == grams
        at, who = at[hit], who[hit]
        overlap = np.zeros((len(tile), len(others)), np.float32)
        in_dense = number[at] >= 0
        for low in range(0, len(dense), 1024):  # frequent columns: dense slabs
            high = min(low + 1024, len(dense))
            mine = in_dense & (number[at] >= low) & (number[at] < high)
            if mine.any():
                left = np.zeros((len(tile), high - low), np.float32)
                left[who[mine], number[at[mine]] - low] = 1
                right = np.zeros((high - low, len(others)), np.float32)
                for c in range(low, high):
                    s = starts[dense[c]]
                    right[c - low, owner[s : s + counts[dense[c]]]] = 1
                overlap += left @ right
        rare_at, rare_who = at[~in_dense], who[~in_dense]
        times = counts[rare_at]
        step = 1 << 20
        bounds = np.concatenate([[0], np.cumsum(times)])
        low = 0
        while low < len(rare_at):  # rare columns: their few pairs one by one
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + step, "right")) - 1)
            t = times[low:high]
            inner = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
            other = owner[np.repeat(starts[rare_at[low:high]], t) + inner]
            flat = np.repeat(rare_who[low:high], t) * len(others) + other
            overlap += np.bincount(flat, minlength=overlap.size).reshape(overlap.shape)
            low = high
        need = _required(size_a[:, None], size_b[None, :])
        linked = (overlap >= need) & _sizes_allow(size_a[:, None], size_b[None, :])
        i, j = np.nonzero(linked)
        yield i + begin, j


def _family_links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the links inside families."""
    nodes = rows.where("node is not null").select("node", *KEYS).distinct()
    keyed = nodes.select(F.explode(F.array(*KEYS)).alias("family"), "node").distinct()
    # Families of the same nodes are one: equal in number and in the 64 bits of their hashes.
    each = keyed.groupBy("family").agg(
        F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("who")
    )
    same = each.where("members > 1").groupBy("members", "who").agg(F.min("family").alias("family"))
    families = written(same.select("family", "members"), "families")
    wanted = NumberFilter(families.select("family"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()  # copies in this task's rows are sent once
        for batch in batches:
            for _, _, part in parts(batch.column("text")):
                out = []
                sets = [s for s in text_sets(part) if len(s)]
                keys = np.array([keys_of(s) for s in sets], np.uint64).reshape(-1, len(KEYS))
                passes = wanted.has(keys)
                for own, pair, ok in zip(sets, keys, passes, strict=True):
                    if not ok.any():
                        continue
                    node = node_of(own)
                    for key in {int(k) for k, o in zip(pair, ok, strict=True) if o}:
                        if (key, int(node)) not in sent:
                            sent.add((key, int(node)))
                            out.append((key, node, own.tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [
                            _signed([k for k, _, _ in out]),
                            _signed([n for _, n, _ in out]),
                            pa.array([s for _, _, s in out], pa.binary()),
                        ],
                        ["family", "node", "grams"],
                    )

    sets = docs.select("text").mapInArrow(members, "family bigint, node bigint, grams binary")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    low = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda other: F.struct(
            F.least(own, other).alias("block_a"),
            F.greatest(own, other).alias("block_b"),
            own.alias("block"),
        ),
    )
    placed = sets.join(families, "family").select("family", "node", "grams", F.inline(low))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, "family", "block_a", "block_b"):
            nodes, at = np.unique(run.column("node").to_numpy(), return_index=True)
            if len(nodes) < 2:
                continue
            grams = run.column("grams")
            sets = [np.frombuffer(grams[int(i)].as_buffer(), np.uint64) for i in at]
            forest = _Forest(len(nodes))
            if len(nodes) <= 4:
                for i in range(len(sets)):
                    for j in range(i):
                        n, m = len(sets[i]), len(sets[j])
                        if _sizes_allow(n, m):
                            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                            if both >= _required(n, m):
                                forest.link(i, j)
            else:
                block = run.column("block").to_numpy()[at]
                side_a = np.flatnonzero(block == run.column("block_a")[0].as_py())
                side_b = np.flatnonzero(block == run.column("block_b")[0].as_py())
                if len(side_a) and len(side_b):
                    mine, others = [sets[i] for i in side_a], [sets[i] for i in side_b]
                    for i, j in product_links(mine, others):
                        for x, y in zip(side_a[i].tolist(), side_b[j].tolist(), strict=True):
                            forest.link(x, y)
            edges = forest.edges()
            if edges:
                pairs = nodes[np.array(edges)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"]
                )

    ordered = by_key(placed, "family", "block_a", "block_b")
    return ordered.mapInArrow(linked, "a bigint, b bigint").distinct()


def _prefix_columns(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Entries of columns that several nodes share: (gram, node, n, at).

    A row with ``other`` is a pair: ``n`` and ``at`` are its nodes' sizes, ``times`` the number of
    short columns of one task that it shares, and ``gram`` how many of them may be its first.  The rest
    are entries of long columns.
    """
    seen = rows.where("gram is not null").groupBy("gram").agg(F.sum("seen").alias("seen"))
    often = most_frequent(seen, "seen", FREQUENT).collect()  # FREQUENT numbers at most
    grams = np.array([r["gram"] for r in often], np.int64).view(np.uint64)
    order = np.argsort(grams)
    counts = np.array([r["seen"] for r in often], np.int64)[order]
    shared = docs.sparkSession.sparkContext.broadcast((grams[order], counts))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen = shared.value
        sent: set[int] = set()
        for batch in batches:
            for _, _, part in parts(batch.column("text")):
                found, node_list, sizes = [], [], []
                for own in text_sets(part):
                    if not len(own):
                        continue
                    node = node_of(own)
                    if int(node) in sent:
                        continue
                    sent.add(int(node))
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                        weight = np.where(frequent[at] == own, seen[at], 0)
                        if weight.any():
                            own = own[np.lexsort((own, weight))]
                    top, bottom = SIMILARITY
                    keep = len(own) - -(-top * len(own) // bottom) + 1
                    found.append(own[:keep])
                    node_list.append(node)
                    sizes.append(len(own))
                if found:
                    lengths = np.array([len(f) for f in found])
                    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                    yield pa.RecordBatch.from_arrays(
                        [
                            _signed(np.concatenate(found)),
                            _signed(np.repeat(np.array(node_list, np.uint64), lengths)),
                            pa.array(np.repeat(sizes, lengths), pa.int32()),
                            pa.array(at, pa.int32()),
                        ],
                        ["gram", "node", "n", "at"],
                    )

    def shared_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            return tuple(rows.column(c).to_numpy() for c in ("gram", "node", "n", "at"))

        def out(gram, node, n, at, other=None, times=None) -> pa.RecordBatch:
            none = pa.nulls(len(gram), pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(gram, pa.int64()),
                    pa.array(node, pa.int64()),
                    pa.array(n, pa.int32()),
                    pa.array(at, pa.int32()),
                    none if other is None else pa.array(other, pa.int64()),
                    none if times is None else pa.array(times, pa.int64()),
                ],
                ["gram", "node", "n", "at", "other", "times"],
            )

        held: pa.RecordBatch | None = None  # the last column, as far as it came; short
        flowing: int | None = None  # a long column that goes straight through
        passed_last: tuple | None = None  # its last entry
        for batch in batches:
            if held is not None:
                batch = joined([held, batch])
                held = None
            if not batch.num_rows:
                continue
            gram, node, n, at = packed(batch)
            fresh = np.ones(len(gram), bool)  # copies of a node come from several tasks
            fresh[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
            fresh[0] = (gram[0], node[0]) != passed_last
            if not fresh.all():
                batch = batch.filter(pa.array(fresh))
                gram, node, n, at = gram[fresh], node[fresh], n[fresh], at[fresh]
            if not len(gram):
                continue
            cuts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1], [True]]))
            lengths = np.diff(cuts)
            if flowing is not None and gram[0] != flowing:
                flowing = None
            long = lengths > SHORT_COLUMN
            if flowing is not None:
                long[0] = True
            if not long[-1]:  # may go on in the next batch
                held = batch.slice(int(cuts[-2]))
            passed = np.repeat(long, lengths)
            if passed.any():
                yield out(gram[passed], node[passed], n[passed], at[passed])
            flowing = int(gram[-1]) if long[-1] else None
            passed_last = (gram[-1], node[-1]) if long[-1] else None
            short = ~long & (lengths > 1)
            short[-1] = False
            if short.any():
                yield from _short_pairs(cuts[:-1][short], lengths[short], node, n, at, out)
        if held is not None and held.num_rows > 1:
            _, node, n, at = packed(held)
            yield from _short_pairs(np.array([0]), np.array([len(node)]), node, n, at, out)

    schema = "gram bigint, node bigint, n int, at int"
    matrix = docs.select("text").mapInArrow(entries, schema)
    matrix = matrix.repartition("gram").sortWithinPartitions("gram", "node")
    return matrix.mapInArrow(shared_columns, schema + ", other bigint, times bigint")


def _short_pairs(starts, lengths, node, n, at, out) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes in short columns, in how many of them they are, and in how many these may be
    the first n-gram that both have."""
    left, right = [], []
    for size in np.unique(lengths):
        i, j = np.triu_indices(int(size), 1)
        begin = starts[lengths == size][:, None]
        left.append((begin + i).ravel())
        right.append((begin + j).ravel())
    x, y = np.concatenate(left), np.concatenate(right)
    ok = _sizes_allow(n[x], n[y]) & (node[x] != node[y])
    x, y = x[ok], y[ok]
    swap = node[x] > node[y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    order = np.lexsort((node[y], node[x]))
    x, y = x[order], y[order]
    if not len(x):
        return
    first = np.concatenate([[0], np.cumsum(_may_be_first(n[x], at[x], n[y], at[y]))])
    fresh = np.ones(len(x), bool)
    fresh[1:] = (node[x][1:] != node[x][:-1]) | (node[y][1:] != node[y][:-1])
    at_pair = np.flatnonzero(fresh)
    bounds = np.append(at_pair, len(x))
    x, y = x[at_pair], y[at_pair]
    yield out(np.diff(first[bounds]), node[x], n[x], n[y], node[y], np.diff(bounds))


def _least_shared(n: Column, m: Column) -> Column:
    """Least number of n-grams that linked sets share among their first ones (see ``entries``).

    Up to the end of whichever prefix ends earlier in the order, all shared n-grams are in both
    prefixes; what follows is at most the rest of that set.
    """
    top, bottom = SIMILARITY
    rest = F.ceil(F.greatest(n, m) * top / bottom) - 1
    return F.ceil((n + m) * top / (top + bottom)) - rest


def _apart(left: str, right: str) -> str:
    """Condition that two nodes are neither connected nor met in a family."""
    return " and ".join(f"{left}.{c} <> {right}.{c}" for c in ["label", *KEYS])


def _across(columns: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b, n, m): pairs out of long columns, of nodes apart, whose first shared n-gram may be theirs."""
    entries = columns.where("other is null").select("gram", "node", "n", "at")
    sizes = entries.groupBy("gram").agg(F.count("*").alias("members")).where(F.col("members") > BLOCK)
    blocks = F.ceil(F.coalesce("members", F.lit(1)) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    spread = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda other: F.struct(
            F.least(own, other).alias("block_a"), F.greatest(own, other).alias("block_b"), own.alias("block")
        ),
    )
    placed = (
        entries.join(known, "node").join(sizes, "gram", "left")
        .select("gram", "node", "n", "at", "label", *KEYS, F.inline(spread))
    )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, "gram", "block_a", "block_b"):
            column = {c: run.column(c).to_numpy() for c in run.schema.names}
            node, n, at, label, block = (column[c] for c in ("node", "n", "at", "label", "block"))
            side_a, side_b = (np.flatnonzero(block == column[c][0]) for c in ("block_a", "block_b"))
            values, counts = np.unique(label, return_counts=True)
            if len(values) < 2:
                continue
            # the largest component isn't compared with itself, so its rows need no turn
            largest = values[counts.argmax()]
            turns = [(side_a[label[side_a] != largest], side_b)]
            if column["block_a"][0] != column["block_b"][0]:
                turns.append((side_b[label[side_b] != largest], side_a[label[side_a] == largest]))
            for rows, others in turns:
                for begin in range(0, len(rows), 256):
                    x, y = rows[begin : begin + 256, None], others[None, :]
                    ok = _sizes_allow(n[x], n[y]) & _may_be_first(n[x], at[x], n[y], at[y])
                    for name in ("label", *KEYS):
                        ok &= column[name][x] != column[name][y]
                    i, j = np.nonzero(ok)
                    x, y = rows[begin + i], others[j]
                    # inside one block, a pair of two small components comes up from both sides
                    once = (node[x] < node[y]) | (label[y] == largest) | (block[x] != block[y])
                    x, y = x[once], y[once]
                    swap = node[x] > node[y]
                    x, y = np.where(swap, y, x), np.where(swap, x, y)
                    if len(x):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(node[x]), pa.array(node[y]), pa.array(n[x]), pa.array(n[y])], ["a", "b", "n", "m"]
                        )

    ordered = by_key(placed, "gram", "block_a", "block_b")
    return ordered.mapInArrow(pairs, "a bigint, b bigint, n int, m int")


def _candidates(columns: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes apart that share enough for their sizes, as far as their prefixes tell."""
    short = columns.where("other is not null").select(
        F.col("node").alias("a"), F.col("other").alias("b"), "n", F.col("at").alias("m"), "times", F.col("gram").alias("first")
    )
    across = _across(columns, known).select("a", "b", "n", "m", F.lit(0).alias("times"), F.lit(1).alias("first"))
    # entries in long columns, of nodes that have any
    long = columns.where("other is null").groupBy(F.col("node").alias("of")).agg(F.count("*").alias("long"))
    shared = short.unionAll(across).groupBy("a", "b").agg(
        F.min("n").alias("n"), F.min("m").alias("m"), F.sum("times").alias("times"), F.sum("first").alias("first")
    )
    shared = shared.where("first > 0").join(known.alias("x"), F.col("a") == F.col("x.node"))
    shared = shared.join(known.alias("y"), F.col("b") == F.col("y.node")).where(_apart("x", "y"))
    shared = shared.join(long.select("of", F.col("long").alias("long_a")), F.col("a") == F.col("of"), "left").drop("of")
    shared = shared.join(long.select("of", F.col("long").alias("long_b")), F.col("b") == F.col("of"), "left")
    most = F.col("times") + F.least(F.coalesce("long_a", F.lit(0)), F.coalesce("long_b", F.lit(0)))
    return shared.where(most >= _least_shared(F.col("n"), F.col("m"))).select("a", "b")


def _checked(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(a, b): the candidates that are links by their whole sets."""
    needed = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = NumberFilter(needed)

    def wanted_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for _, _, part in parts(batch.column("text")):
                sets = [s for s in text_sets(part) if len(s)]
                nodes = np.array([node_of(s) for s in sets], np.uint64)
                out = []
                for own, node, ok in zip(sets, nodes, wanted.has(nodes), strict=True):
                    if ok and int(node) not in sent:
                        sent.add(int(node))
                        out.append((node, own.tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [_signed([n for n, _ in out]), pa.array([s for _, s in out], pa.binary())],
                        ["node", "grams"],
                    )

    sets = docs.select("text").mapInArrow(wanted_sets, "node bigint, grams binary")
    sets = sets.join(needed, "node").dropDuplicates(["node"])
    sets = written(sets, "candidate-sets")
    both = candidates.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("of_a")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("of_b")), "b")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= _required(len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "of_a", "of_b").mapInArrow(links, "a bigint, b bigint")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    rows = written(_described(docs), "ngram-rows")
    inside = written(_family_links(docs, rows), "family-links")
    first = written(components(inside), "family-components")
    columns = written(_prefix_columns(docs, rows), "prefix-columns")
    nodes = rows.where("node is not null").select("node", *KEYS).distinct()
    known = nodes.join(first, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = written(known, "nodes")
    candidates = written(_candidates(columns, known), "candidates")
    links = inside.unionAll(_checked(docs, candidates))
    labels = components(links)
    ids = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("own_id"))
    named = ids.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("own_id").alias("component_id"))
    of_node = named.join(least, "label").select("node", "component_id")
    of_rows = rows.where("gram is null").select("doc_id", F.col("n").alias("n_shingles"), "node")
    return of_rows.join(of_node, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One row of each component, the one with the smallest id, columns unchanged.

    Rows are told apart by number, not by id: an id that stands on rows of different texts may stay
    once for each component.  Of rows with the smallest id the text with the smallest hash stays.
    Rows without an id stay only where their whole component has none.  Texts without words are
    linked with nothing, but of rows that repeat both id and text one stays.
    """
    mark = free_name(docs, "mark")
    marked = written(docs.withColumn(mark, F.monotonically_increasing_id()), "marked")
    found = jaccard_components(marked.select(F.col(mark).alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("row"), "n_shingles", "component_id")
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = marked.select(F.col(mark).alias("of_row"), "doc_id", hashed.alias("hash"))
    wordless = F.col("n_shingles") == 0
    alike = [
        F.when(~wordless | F.col("doc_id").isNull(), F.col("component_id")).alias("component"),
        F.when(wordless, F.col("doc_id")).alias("id"),
        F.when(wordless & F.col("doc_id").isNotNull(), F.col("hash")).alias("text_hash"),
    ]
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "hash", "row")
    kept = found.join(rows, F.col("row") == F.col("of_row")).groupBy(*alike).agg(F.min(order).alias("least"))
    kept = kept.select(F.col("least.row").alias("kept_row"))
    return marked.join(kept, F.col(mark) == F.col("kept_row"), "left_semi").drop(mark)
