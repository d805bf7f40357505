"""Whitening of embeddings on their leading principal components, by spectrum slicing.

Entries are quantised to whole numbers; every distinct vector counts once.  Sums are exact, and so
is the centring: n * x - S is a whole number, rounded once when it is divided by n.  Partitions add up
centred products; only the table of one number for each pair of dimensions reaches the driver.

The eigenvalues of that table V come from inertia counts: V - shift * I = L D L' has as many positive
eigenvalues as D (Sylvester), so a count tells how many eigenvalues of V lie above a shift.  Counts
halve intervals until each holds one eigenvalue, or several that double precision doesn't tell
apart.  Inverse iteration at the interval's middle starts Rayleigh quotient iteration, which
converges cubically to the interval's vector.  Two further counts, just above and below the value
found, certify its number; where they don't, the interval is halved further.

Rows whose vector is null, holds a null or non-finite entry, or an entry that leaves the 64-bit
range when quantised, are left out; so are vectors of another length than most (of equally many, the
longer).  Components whose eigenvalue is zero up to rounding can't be scaled and are left out: fewer
distinct vectors than dimensions give fewer components, one alone gives none.  Repeated rows are
answered each.  Extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opatlas.llm.tables import written

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
BLOCK_ROWS = 2048
RESULT = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)
_EPSILON = float(np.finfo(float).eps)
_MOST_LONG = 2**63 - 1


# Inertia, slicing and Rayleigh quotients, on one table of dimension x dimension numbers


def positive_pivots(matrix: np.ndarray) -> int:
    """Number of positive eigenvalues, from the signs of D in P A P' = L D L'.

    Symmetric pivoting with blocks of one or two rows keeps the factors bounded for indefinite tables.
    """
    a = matrix.copy()
    positive = 0
    growth = (1 + 17**0.5) / 8
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        r, q = divmod(int(off.argmax()), len(a))
        if diagonal[p] == 0 and off[r, q] == 0:
            break  # what is left is zero
        taken = [p] if diagonal[p] >= growth * off[r, q] else sorted([r, q])
        block = a[np.ix_(taken, taken)]
        if len(taken) == 1:
            positive += int(block[0, 0] > 0)
        else:
            positive += 1  # chosen so that its determinant is negative: one of each sign
        rest = np.delete(np.arange(len(a)), taken)
        side = a[np.ix_(rest, taken)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return positive


@dataclass(frozen=True)
class Slice:
    """Eigenvalues number ``first`` to ``last`` (from 1, largest first) lie in low .. high."""

    low: float
    high: float
    first: int
    last: int


class Spectrum:
    """The leading eigenvalues and vectors of a symmetric table without negative eigenvalues."""

    def __init__(self, matrix: np.ndarray) -> None:
        self.matrix = matrix
        self.size = len(matrix)
        self.norm = float(np.abs(matrix).sum(axis=1).max()) if self.size else 0.0
        self.least = 8 * max(self.size, 1) * _EPSILON * self.norm

    def above(self, shift: float) -> int:
        """How many eigenvalues are greater than ``shift``."""
        return positive_pivots(self.matrix - shift * np.eye(self.size))

    def halves(self, own: Slice) -> list[Slice]:
        middle = (own.low + own.high) / 2
        n = min(max(self.above(middle), own.first - 1), own.last)
        parts = [Slice(middle, own.high, own.first, n), Slice(own.low, middle, n + 1, own.last)]
        return [p for p in parts if p.first <= p.last]

    def vectors_of(self, own: Slice, known: list[np.ndarray]) -> list[tuple[float, np.ndarray]] | None:
        """Values and vectors of a slice, or None where Rayleigh quotients leave it."""
        found: list[tuple[float, np.ndarray]] = []
        for number in range(own.first, own.last + 1):
            start = np.random.Generator(np.random.PCG64(number)).standard_normal(self.size)
            shift, vector = (own.low + own.high) / 2, start
            before = [*known, *[v for _, v in found]]
            for turn in range(60):
                vector = self._solved(shift, vector)
                for _ in range(2):  # twice is enough
                    for other in before:
                        vector = vector - (other @ vector) * other
                vector /= np.linalg.norm(vector)
                product = self.matrix @ vector
                value = float(vector @ product)
                rest = float(np.linalg.norm(product - value * vector))
                if turn > 1 and rest <= self.least:
                    break
                if turn > 1 and own.low - rest <= value <= own.high + rest:
                    shift = value  # inverse iteration first, then the Rayleigh quotient
            if rest > 4 * self.least or not own.low - self.least <= value <= own.high + self.least:
                return None
            found.append((value, vector))
        return sorted(found, key=lambda x: -x[0])

    def _solved(self, shift: float, vector: np.ndarray) -> np.ndarray:
        for attempt in range(8):
            moved = shift + attempt * max(self.least / 64, _EPSILON * abs(shift))
            try:
                out = np.linalg.solve(self.matrix - moved * np.eye(self.size), vector)
            except np.linalg.LinAlgError:
                continue  # the shift is an eigenvalue to the last bit
            if np.isfinite(out).all():
                return out / np.linalg.norm(out)
        return vector

    def certified(self, own: Slice, found: list[tuple[float, np.ndarray]]) -> bool:
        """The counts just beside the slice's values give the numbers it claims."""
        return self.above(found[0][0] + 8 * self.least) <= own.first - 1 and self.above(found[-1][0] - 8 * self.least) >= own.last

    def leading(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(values, vectors as columns) of at most ``most`` eigenvalues, largest first, none of them zero."""
        wanted = min(most, self.above(self.least)) if self.norm > 0 else 0
        values: list[float] = []
        vectors: list[np.ndarray] = []
        waiting = [Slice(0.0, self.norm * (1 + 4 * _EPSILON), 1, self.size)] if wanted else []
        while waiting:
            own = waiting.pop()
            if own.first > wanted:
                continue
            together = own.high - own.low <= 4 * self.least
            if own.first == own.last or together:
                found = self.vectors_of(own, vectors)
                if found is not None and (together or self.certified(own, found)):
                    values += [v for v, _ in found]
                    vectors += [v for _, v in found]
                    continue
                if together:
                    raise ArithmeticError("the table's eigenvalues can't be told apart in double precision")
            waiting += reversed(self.halves(own))  # the greater half is next
        return np.array(values[:wanted]), np.array(vectors[:wanted]).reshape(len(vectors[:wanted]), self.size).T


# Sums over the table


def quantised(embedding: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * scale).cast("bigint") + shift)


def _usable(embedding: Column, scale: int = SCALE) -> Column:
    most = float(2**62 // scale)

    def good(c: Column) -> Column:
        return F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < most), F.lit(False))

    return embedding.isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, good)


def quantised_rows(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    vectors = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("embedding"))
    vectors = vectors.where(_usable(F.col("embedding")))
    sizes = vectors.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("times"))
    most = sizes.orderBy(F.desc("times"), F.desc("size")).limit(1)
    size = next((r["size"] for r in most.collect()), 0)
    return vectors.where(F.size("embedding") == size).select("vec_id", quantised(F.col("embedding")).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], name: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Some rows at a time, and their vectors as a table of whole numbers, less the shift."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            flat = part.column(name).flatten().to_numpy(zero_copy_only=False)
            yield part, flat.reshape(part.num_rows, -1) - SHIFT


@dataclass(frozen=True)
class Centre:
    """Number of vectors, exact sums by dimension (of x less the shift), and the largest |x| of these."""

    n: int
    sums: tuple[int, ...]
    largest: int

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: in 64 bits where that is enough, else in Python's whole numbers."""
        if 2 * self.n * max(self.largest, int(np.abs(x).max(initial=0))) < _MOST_LONG:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2 of each row, exact; None where it doesn't fit a long."""
        scaled = self.scaled(x)
        most = int(np.abs(scaled).max(initial=0))
        if most * most * x.shape[1] > _MOST_LONG:
            scaled = scaled.astype(object)
        return [s if s <= _MOST_LONG else None for s in map(int, (scaled * scaled).sum(axis=1))]


def centre_of(distinct: DataFrame) -> Centre:
    """Exact sums: halves of the numbers are added up apart, so that no sum leaves 64 bits."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, largest, sums = 0, 0, None
        for _, x in _blocks(batches):
            n += len(x)
            largest = max(largest, int(x.max()), -int(x.min()))
            own = [(x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()]
            own = [(h << 32) + low for h, low in zip(*own, strict=True)]
            sums = own if sums is None else [a + b for a, b in zip(sums, own, strict=True)]
        if n:
            places = pa.array(range(len(sums)), pa.int32())
            totals = [pa.array([str(s) for s in sums]), pa.array([n] * len(sums)), pa.array([str(largest)] * len(sums))]
            yield pa.RecordBatch.from_arrays([places, *totals], ["place", "total", "n", "largest"])

    parts = distinct.mapInArrow(added, "place int, total string, n bigint, largest string")
    wide = "decimal(38,0)"
    # one row for each dimension
    rows = parts.groupBy("place").agg(
        F.sum(F.col("total").cast(wide)).alias("total"), F.sum("n").alias("n"), F.max(F.col("largest").cast(wide)).alias("largest")
    ).orderBy("place").collect()
    if not rows:
        return Centre(0, (), 0)
    return Centre(rows[0]["n"], tuple(int(r["total"]) for r in rows), max(int(r["largest"]) for r in rows))


def products(distinct: DataFrame, centre: Centre, basis: np.ndarray | None = None) -> np.ndarray:
    """Mean centred products of all pairs of dimensions; with ``basis``, of the projected vectors.

    A task adds up its own products; one row for each dimension and task is shuffled, and the sums
    have one row for each dimension.  Projected vectors are centred by their own mean, too.
    """
    size = len(centre.sums) if basis is None else basis.shape[1]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size))
        seen = False
        for _, x in _blocks(batches):
            rows = centre.centred(x)
            rows = rows if basis is None else rows @ basis
            total[:size] += rows.T @ rows
            total[size] += rows.sum(axis=0)
            seen = True
        if seen:
            cells = pa.ListArray.from_arrays(np.arange(0, total.size + 1, size, dtype=np.int32), total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(range(size + 1), pa.int32()), cells], ["place", "cells"])

    parts = distinct.mapInArrow(added, "place int, cells array<double>")
    cells = parts.select("place", F.posexplode("cells").alias("other", "cell"))
    sums = cells.groupBy("place", "other").agg(F.sum("cell").alias("cell"))
    out = np.zeros((size + 1, size))
    for r in sums.collect():  # one number for each pair of dimensions
        out[r["place"], r["other"]] = r["cell"] / centre.n
    return out[:size] - np.outer(out[size], out[size])


@dataclass(frozen=True)
class Whitening:
    """What whitening a vector takes: ``basis`` has a column for each component, scaled."""

    centre: Centre
    values: np.ndarray
    basis: np.ndarray
    explained: np.ndarray
    identity_error: float


def fitted(distinct: DataFrame, components: int = COMPONENTS) -> Whitening:
    centre = centre_of(distinct)
    size = len(centre.sums)
    table = products(distinct, centre) if centre.n else np.zeros((size, size))
    table = (table + table.T) / 2
    values, vectors = Spectrum(table).leading(components)
    basis = vectors / np.sqrt(values)
    error = 0.0
    if len(values):
        error = float(np.abs(products(distinct, centre, basis) - np.eye(len(values))).max())
    trace = float(np.trace(table))
    return Whitening(centre, values, basis, values / trace if trace > 0 else values, error)


def whitened(vectors: DataFrame, model: Whitening) -> DataFrame:
    """A row for each vector and component (``RESULT``)."""
    k = len(model.values)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not k:
            return
        for part, x in _blocks(batches):
            rows = len(x)
            columns = [
                part.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.centre.n)),
                pa.array(model.centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array((model.centre.centred(x) @ model.basis).ravel()),
                pa.array(np.tile(model.explained, rows)),
                pa.array(np.full(rows * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in RESULT.split(", ")])

    return vectors.mapInArrow(projected, RESULT)


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened leading components of every vector that takes part."""
    vectors = quantised_rows(rows)
    # equal vectors meet in their map task first, so a vector of very many rows is sent once by each
    distinct = written(vectors.select("x").distinct(), "vectors")
    return whitened(vectors, fitted(distinct, components))
