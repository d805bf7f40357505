"""Quality classifier: a conditional random field over the lines of a document.

Every line that holds a word is labelled good or bad from its own and its neighbours' features;
the forward-backward marginals of "good", weighted by the lines' characters, average to the score
of the document.  A text without words (null, empty, white space only) has no lines and the
score 0.  Texts are scored whole and by themselves, so repeated rows score alike; extra columns
don't matter; an empty table gives an empty result.  Without labelled rows nothing can be
learned: documents with words then score 0.5.

The field is fitted on at most ``SAMPLE_ROWS`` labelled documents of each quality, those with the
smallest hash of their id; both classes are weighed back to their counts in all labelled rows.
A document's label stands for each of its lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from opatlas.llm.crf import Batch, Field, fit
from opatlas.llm.tables import free_name, remainder, text_of
from opatlas.llm.word_arrays import Texts, parts

SAMPLE_ROWS = 1500
HOLD_OUT = 5
GOOD_FROM = 0.3
ROUNDS, RATE, DECAY = 80, 0.15, 1e-4

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_STOPS = np.zeros(256, bool)
_STOPS[np.frombuffer(b".,;:?", np.uint8)] = True
_OWN = 15
FEATURES = 3 * _OWN + 1


def line_features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line of each text, characters of each line, features of each line)."""
    data, bounds = texts.data, texts.bounds
    words = texts.words(lower=False)
    breaks = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([bounds, breaks + 1]))  # where lines may begin
    line_of_word = np.searchsorted(cuts, words.starts, "right") - 1
    used, line_of_word = np.unique(line_of_word, return_inverse=True)
    begin = cuts[used]
    stop = cuts[np.minimum(used + 1, len(cuts) - 1)] if len(used) else begin
    n = len(used)
    row = np.searchsorted(bounds, begin, "right") - 1
    if n:  # several empty texts may begin at the same place
        row = np.searchsorted(bounds[1:], begin, "right")
    first = np.searchsorted(row, np.arange(len(texts) + 1))

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return (sums[stop] - sums[begin]).astype(float)

    upper = (data >= 65) & (data <= 90)
    upper[1:] |= (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)
    chars = total((data & 0xC0) != 0x80)
    per = np.bincount(line_of_word, minlength=n).astype(float)
    size = (words.stops - words.starts).astype(float)
    hashes = words.hashes()
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    key = np.lexsort((hashes, line_of_word))
    fresh = np.ones(len(key), bool)
    fresh[1:] = (hashes[key][1:] != hashes[key][:-1]) | (line_of_word[key][1:] != line_of_word[key][:-1])
    distinct = np.bincount(line_of_word[key][fresh], minlength=n)
    lines = words.ranges().of(begin, stop)
    pairs = np.lexsort((lines, row))
    copy = np.zeros(n, bool)
    if n > 1:
        same = (lines[pairs][1:] == lines[pairs][:-1]) & (row[pairs][1:] == row[pairs][:-1])
        copy[pairs[1:]] = same
        copy[pairs[:-1]] |= same
    share = lambda x: x / np.maximum(chars, 1)
    by_word = lambda x: x / np.maximum(per, 1)
    in_line = lambda x: np.bincount(line_of_word, weights=x, minlength=n)
    symbols = total(_SYMBOLS[data])
    own = np.stack(
        [
            np.log1p(per) / 5,
            by_word(symbols),
            np.sqrt(by_word(symbols)),
            share(total(upper)),
            np.sqrt(by_word(total(data == 124))),
            by_word(total(data == 33)),
            share(total((data >= 48) & (data <= 57))),
            by_word(total(_STOPS[data])),
            by_word(in_line(size)) / 10,
            by_word(in_line(size <= 3)),
            by_word(in_line(again)),
            1 - by_word(distinct),
            (1 - by_word(distinct)) * np.log1p(per) / 5,
            copy.astype(float),
            (per <= 3).astype(float),
        ],
        axis=1,
    ).clip(0, 5)
    before, after = np.zeros_like(own), np.zeros_like(own)
    if n > 1:
        same = (row[1:] == row[:-1])[:, None]
        before[1:] = own[:-1] * same
        after[:-1] = own[1:] * same
    return first, chars, np.concatenate([own, before, after, np.ones((n, 1))], axis=1)


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> list:
    """(quality, weight, features) of the sampled documents; features are made in the tasks."""
    known = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .where(remainder(HOLD_OUT) != 0)
    )
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    chosen = None
    for quality in (0, 1):
        own = known.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = own if chosen is None else chosen.unionAll(own)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * rows ids at most
    # one text for each id, however many rows it stands on
    texts = texts.groupBy("doc_id").agg(F.min(text_of()).alias("text"), F.min("quality").alias("quality"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quality = batch.column("quality").cast(pa.int32())
            for begin, stop, part in parts(batch.column("text")):
                first, _, features = line_features(part)
                packed = [
                    features[a:b].astype(np.float32).tobytes()
                    for a, b in zip(first[:-1], first[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [quality.slice(begin, stop - begin), pa.array(packed, pa.binary())], ["quality", "features"]
                )

    found = texts.mapInArrow(featured, "quality int, features binary").collect()
    sampled: dict[int, int] = {}
    for r in found:
        sampled[r["quality"]] = sampled.get(r["quality"], 0) + 1
    return [
        (r["quality"], counts[r["quality"]] / sampled[r["quality"]], np.frombuffer(r["features"], np.float32))
        for r in found
        if len(r["features"])
    ]


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Field | None:
    """The field learned from a bounded sample; None when no labelled document has a line."""
    sample = _sample(docs, labels, rows)
    if not sample:
        return None
    matrices = [values.reshape(-1, FEATURES) for _, _, values in sample]
    lengths = np.array([len(m) for m in matrices])
    features = np.concatenate(matrices).astype(float)
    labels_of = np.repeat([quality for quality, _, _ in sample], lengths)
    # each document counts once, however many lines it has
    batch = Batch(
        first=np.concatenate([[0], np.cumsum(lengths)]),
        labels=labels_of,
        counts=np.array([weight for _, weight, _ in sample]),
        emit=lambda weights: features @ weights,
        collect=lambda values: features.T @ values,
    )
    return fit([batch], FEATURES, 2, ROUNDS, RATE, DECAY)


def _scores(field: Field | None, texts: Texts) -> np.ndarray:
    first, chars, features = line_features(texts)
    if field is None:
        good = np.full(len(chars), 0.5)
    else:
        good = field.marginals(first, features @ field.weights)[:, 1]
    sums, sizes = np.zeros(len(chars) + 1), np.zeros(len(chars) + 1)
    np.cumsum(good * chars, out=sums[1:])
    np.cumsum(chars, out=sizes[1:])
    weight = sizes[first[1:]] - sizes[first[:-1]]
    return ((sums[first[1:]] - sums[first[:-1]]) / np.maximum(weight, 1)).clip(0, 1)


def score_quality(
    docs: DataFrame, field: Field | None, text: str = "text", out: str = "quality_score"
) -> DataFrame:
    """The table with one more column, ``out``: the quality score of its text, 0 to 1."""
    fitted = docs.sparkSession.sparkContext.broadcast(field)  # a few hundred numbers
    schema = StructType([*docs.schema.fields, StructField(out, DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop, part in parts(batch.column(text)):
                scores = pa.array(_scores(fitted.value, part))
                rows = batch.slice(begin, stop - begin)
                yield pa.RecordBatch.from_arrays([*rows.columns, scores], names=schema.names)

    return docs.mapInArrow(scored, schema)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    field = fit_quality(docs, labels)
    return score_quality(docs.select("doc_id", "text"), field).select(
        "doc_id",
        (remainder(HOLD_OUT) == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= GOOD_FROM).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with their own columns; a text without words is."""
    out = free_name(docs, "quality_score")
    kept = score_quality(docs, fit_quality(docs, labels), out=out).where(F.col(out) >= GOOD_FROM)
    return kept.drop(out)
