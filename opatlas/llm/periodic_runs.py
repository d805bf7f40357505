"""Periodic runs of words: stretches that repeat one period at least three times.

A run is a maximal stretch of consecutive words with smallest period q whose length is at least
``LEAST_WORDS`` and ``LEAST_TIMES`` * q.  All runs of a text are found, exactly, in two steps:

1. Recursive frequency splitting.  Every word of a run occurs ``LEAST_TIMES`` times in it, so a word
   that occurs less often within its segment splits the segment there, and segments shorter than
   ``LEAST_WORDS`` go.  Segments that were cut are counted anew until nothing changes.
2. Lag scan of what is left.  For periods in [2^j, 2^(j+1)), the lag from each place to the next
   equal stretch of 2^(j+1) words is taken.  A run of such a period shows one lag, its period, at
   its first length - period - 2^(j+1) + 1 places and at no neighbour of them, so runs are the
   stretches of equal lag; periods below 16 share stretches of 16 words.  This takes O(n log n)
   array operations a scale, where comparing every lag would take n^2 / 3.

Texts are read where they lie: nothing is shuffled, and a task holds a few megabytes of text, or one
longer text.  Counting again costs the segments that were cut only; a text made for it (whose ends
fall off a few words at a time) takes as many rounds as it has such layers.

Null and empty texts have no words and no run.  A null ``doc_id`` counts as one without digits.
Repeated rows are answered each, extra columns don't matter, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opatlas.llm.tables import text_of

LEAST_WORDS, LEAST_TIMES = 24, 3
SHORTEST = 16  # words that a run of the least length shares with itself a period of up to 8 later
PART_BYTES = 2 << 20
DIGEST = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)

Run = tuple[int, int, int]  # start, length, period; in words


def with_period(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, periodic from some place on for a tenth of the ids; id and number of words decide."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    unit = words[start : start + period]
    return words[:start] + (unit * (-(-(n - start) // period)))[: n - start]


def surviving(ids: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of the segments that frequency splitting leaves.

    ``ids`` are the words of several texts, one after the other, ``bounds`` where each starts, and
    the end.  No segment reaches over a bound.
    """
    done: list[tuple[int, int]] = []
    starts, stops = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    words = int(ids.max()) + 1 if len(ids) else 1
    while True:
        long = stops - starts >= LEAST_WORDS
        starts, stops = starts[long], stops[long]
        if not len(starts):
            return sorted(done)
        sizes = stops - starts
        firsts = np.concatenate([[0], np.cumsum(sizes)])
        segment = np.repeat(np.arange(len(sizes)), sizes)
        places = np.arange(firsts[-1]) - firsts[segment] + starts[segment]
        _, which, counts = np.unique(segment * words + ids[places], return_inverse=True, return_counts=True)
        cuts = np.flatnonzero(counts[which] < LEAST_TIMES)
        whole = np.ones(len(sizes), bool)
        whole[segment[cuts]] = False
        done += list(zip(starts[whole].tolist(), stops[whole].tolist(), strict=True))
        # the pieces of a cut segment lie between its cuts
        starts, stops = (
            np.sort(np.concatenate([starts[~whole], places[cuts] + 1])),
            np.sort(np.concatenate([places[cuts], stops[~whole]])),
        )


def lag_runs(ids: np.ndarray) -> list[Run]:
    """All runs of one segment, by start, then period."""
    n = len(ids)
    found: list[Run] = []
    size, places, classes = 1, np.arange(n), ids.astype(np.int64)
    while len(places):
        # ``classes`` tells the stretches of ``size`` words from ``places`` on apart
        if size >= SHORTEST:
            order = np.argsort(classes, kind="stable")
            same = classes[order[1:]] == classes[order[:-1]]
            lag = np.zeros(len(places), np.int64)
            lag[order[:-1][same]] = (places[order[1:]] - places[order[:-1]])[same]
            keep = (lag >= (1 if size == SHORTEST else size // 2)) & (lag < size)
            at, own = places[keep], lag[keep]
            new = np.flatnonzero((np.diff(at) != 1) | (np.diff(own) != 0)) + 1
            heads = np.concatenate([[0], new])[: len(at)]
            tails = np.concatenate([new, [len(at)]])[: len(at)] - 1
            lengths = at[tails] - at[heads] + own[heads] + size
            good = lengths >= np.maximum(LEAST_WORDS, LEAST_TIMES * own[heads])
            found += zip(at[heads][good].tolist(), lengths[good].tolist(), own[heads][good].tolist(), strict=True)
            if size > n // LEAST_TIMES:
                break
        # a stretch of twice the size is two of this size; only those that occur again are kept
        following = np.full(n + size, -1, np.int64)
        following[places] = classes
        second = following[places + size]
        both = second >= 0
        _, doubled, counts = np.unique(classes[both] * (n + 1) + second[both], return_inverse=True, return_counts=True)
        again = counts[doubled] > 1
        size, places, classes = 2 * size, places[both][again], doubled[again]
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text, given as words."""
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for words in texts for w in words], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(words) for words in texts])]).astype(np.int64)
    found: list[list[Run]] = [[] for _ in texts]
    for start, stop in surviving(ids, bounds):
        row = int(np.searchsorted(bounds, start, "right")) - 1
        _, own = np.unique(ids[start:stop], return_inverse=True)
        shift = start - int(bounds[row])
        found[row] += [(s + shift, length, period) for s, length, period in lag_runs(own)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that some run contains after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, [s + q for s, _, q in runs], 1)
    np.add.at(depth, [s + length for s, length, _ in runs], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def most_repeated(runs: list[Run]) -> Run:
    """The run of the greatest length / period; ties go to the smallest start, then period."""
    best = runs[0]
    for run in runs[1:]:
        more = run[1] * best[2] - best[1] * run[2]
        if more > 0 or (more == 0 and (run[0], run[2]) < (best[0], best[2])):
            best = run
    return best


def _sha256(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _digest(doc_id: int | None, words: list[bytes], runs: list[Run]) -> tuple:
    start, length, period = most_repeated(runs) if runs else (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    milli = 1000 * length // period if runs else None
    return (
        doc_id, len(runs), start, length, period, milli, _sha256(listed), _sha256(b" ".join(collapsed(words, runs)))
    )


def _in_parts(batch: pa.RecordBatch) -> Iterator[list[tuple[int | None, bytes]]]:
    part: list[tuple[int | None, bytes]] = []
    size = 0
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
        raw = text.as_py()
        if part and size + len(raw) > PART_BYTES:
            yield part
            part, size = [], 0
        part.append((doc_id, raw))
        size += len(raw)
    yield part


def detected(docs: DataFrame, fixture: bool = False) -> DataFrame:
    """Runs of every text and the text without its repetitions, as checksums (``DIGEST``).

    With ``fixture``, a tenth of the texts are made periodic first (:func:`with_period`).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _in_parts(batch):
                # bytes.split() splits at space and the characters 9 to 13, and at no others
                texts = [raw.split() for _, raw in part]
                if fixture:
                    texts = [with_period(words, i) for words, (i, _) in zip(texts, part, strict=True)]
                rows = [
                    _digest(i, words, runs)
                    for (i, _), words, runs in zip(part, texts, runs_of(texts), strict=True)
                ]
                yield _rows(rows)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().cast("binary").alias("text"))
    return slim.mapInArrow(read, DIGEST)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [column.split(" ")[0] for column in DIGEST.split(", ")]
    kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def run_spans(docs: DataFrame) -> DataFrame:
    """One row for each run: doc_id, start, length, period (in words, from 0)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "period"]
        for batch in batches:
            for part in _in_parts(batch):
                found = runs_of([raw.split() for _, raw in part])
                rows = [(i, *run) for (i, _), runs in zip(part, found, strict=True) for run in runs]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().cast("binary").alias("text"))
    return slim.mapInArrow(read, "doc_id bigint, start bigint, length bigint, period bigint")
