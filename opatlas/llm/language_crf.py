"""Language of texts: a conditional random field labels every word of code-switched text.

A word's emission sums learned weights of the word itself (the lexicon), its affixes of one to
three bytes and its inner trigrams, all hashed into one table; learned transitions say how rarely
the language changes.  Forward-backward marginals give each word's language; their mean over the
words with a letter decides the text, and the winner's share is the score.

A text that is null or has no letter (of any script) has the language ``und`` and the score 1.
Repeated rows are judged alike, extra columns don't matter, an empty table gives an empty result.
Ties go to the language that sorts first.  Without labelled texts every text is ``und``, score 0.

The field is fitted on whole texts of at most ``SAMPLE_ROWS`` rows of each language, those with
the smallest hash of their id.  Half of the chains it learns from are texts as they are, half are
spliced from runs of words of texts of different languages, so that changes can be learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from opatlas.llm.crf import Batch, Field, fit
from opatlas.llm.tables import free_name, remainder
from opatlas.llm.word_arrays import Texts, Words, mixed, parts

SAMPLE_ROWS = 150
HOLD_OUT = 4
HOLD_OUT_REMAINDER = 2
TABLE_BITS = 16
ROUNDS, RATE, DECAY = 4, 0.1, 1e-5
BATCHES = 16
UNKNOWN = "und"
# A text is rejected when no language has this share of its words.
LEAST_SHARE = 0.4

_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = True
_IS_LETTER[128:] = True  # part of a character beyond ASCII


def _slots(hashes: np.ndarray, kind: int) -> np.ndarray:
    seeded = mixed(hashes ^ np.uint64(0x5851F42D4C957F2D * (kind + 1) & (2**64 - 1)))
    return (seeded >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class WordFeatures:
    """Features of the distinct words of some texts: slots of the table, and which words use them."""

    def __init__(self, words: Words) -> None:
        hashes = words.hashes()
        _, at, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        starts, stops = words.starts[at], words.stops[at]
        data, n = words.data, len(at)
        self.n = n
        slots, owners, weights = [_slots(hashes[at], 0)], [np.arange(n)], [np.ones(n)]
        for size in (1, 2, 3):
            long = np.flatnonzero(stops - starts >= size)
            for kind, begin in ((2 * size - 1, starts[long]), (2 * size, stops[long] - size)):
                slots.append(_slots(words.ranges().of(begin, begin + size), kind))
                owners.append(long)
                weights.append(np.ones(len(long)))
        grams = np.maximum(stops - starts - 2, 0)
        owner = np.repeat(np.arange(n), grams)
        begin = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams) + starts[owner]
        code = data[begin].astype(np.uint64) << np.uint64(16)
        code |= data[begin + 1].astype(np.uint64) << np.uint64(8)
        code |= data[begin + 2].astype(np.uint64)
        slots.append(_slots(code, 7))
        owners.append(owner)
        weights.append(3.0 / np.maximum(grams, 3)[owner])  # long words don't weigh more
        letters = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_IS_LETTER[data], out=letters[1:])
        self.lettered = letters[stops] > letters[starts]
        self.slots, self.owners = np.concatenate(slots), np.concatenate(owners)
        self.weights = np.concatenate(weights) * self.lettered[self.owners]

    def emissions(self, table: np.ndarray) -> np.ndarray:
        """Per word of the texts, in order."""
        out = np.empty((self.n, table.shape[1]))
        for k in range(table.shape[1]):
            out[:, k] = np.bincount(self.owners, table[self.slots, k] * self.weights, self.n)
        return out[self.word]

    def collected(self, values: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Values of the given places, summed per slot of the table."""
        out = np.empty((1 << TABLE_BITS, values.shape[1]))
        for k in range(values.shape[1]):
            by_word = np.bincount(self.word[places], values[:, k], self.n)
            out[:, k] = np.bincount(self.slots, by_word[self.owners] * self.weights, 1 << TABLE_BITS)
        return out


def _chains(words: Words, langs: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Places of the words of each chain: every text, and as many splices of several texts."""
    texts = [np.arange(a, b) for a, b in zip(words.first[:-1], words.first[1:], strict=True) if b > a]
    runs = []
    for text in texts:
        at = 0
        while at < len(text):
            size = int(rng.integers(5, 80))
            runs.append(text[at : at + size])
            at += size
    order = rng.permutation(len(runs))
    spliced, at = [], 0
    while at < len(runs):
        size = int(rng.integers(2, 12))
        spliced.append(np.concatenate([runs[i] for i in order[at : at + size]]))
        at += size
    return texts + spliced


def _sample(known: DataFrame, rows: int) -> list[tuple[str, str]]:
    """(text, language) of at most ``rows`` ids of each language, those with the smallest hash.

    Two scans, whatever the number of languages: one ranks ids, which tasks cut down to their own
    ``rows`` first, one reads the chosen texts.  An id of a language gives one text.
    """
    ids = known.where("doc_id is not null").select("lang", "doc_id").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows).drop("rank")
    found = known.where("text is not null").join(chosen, ["lang", "doc_id"], "left_semi")
    texts = found.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    return [(r["text"], r["lang"]) for r in texts.orderBy("lang", F.xxhash64("doc_id"), "doc_id").collect()]


def fit_languages(docs: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[str], Field] | None:
    """(languages, field) learned from text and lang of the rows that aren't held out."""
    known = docs.where("lang is not null").where(remainder(HOLD_OUT) != HOLD_OUT_REMAINDER)
    sample = _sample(known, rows)
    langs = sorted({lang for _, lang in sample})
    column = pa.array([text for text, _ in sample], pa.large_string())
    if not len(column):
        return None
    ((_, _, texts),) = parts(column, most=1 << 62)
    words = texts.words()
    if not len(words):
        return None
    by_text = np.array([langs.index(lang) for _, lang in sample])
    labels = np.repeat(by_text, words.counts())
    features = WordFeatures(words)
    rng = np.random.Generator(np.random.PCG64(7))
    chains = _chains(words, labels, rng)
    order = rng.permutation(len(chains))
    batches = []
    for own in np.array_split(order, min(BATCHES, len(order))):
        lengths = np.array([len(chains[i]) for i in own])
        places = np.concatenate([chains[i] for i in own])
        batches.append(
            Batch(
                first=np.concatenate([[0], np.cumsum(lengths)]),
                labels=labels[places],
                counts=np.ones(len(own)),
                emit=lambda table, places=places: features.emissions(table)[places],
                collect=lambda values, places=places: features.collected(values, places),
            )
        )
    return langs, fit(batches, 1 << TABLE_BITS, len(langs), ROUNDS, RATE, DECAY)


def word_marginals(field: Field, texts: Texts) -> tuple[Words, WordFeatures, np.ndarray]:
    """Words of the texts and the marginals of their languages."""
    words = texts.words()
    features = WordFeatures(words)
    return words, features, field.marginals(words.first, features.emissions(field.weights))


def _judged(langs: list[str], field: Field, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    words, features, marginals = word_marginals(field, texts)
    lettered = features.lettered[features.word]
    rows = words.rows()[lettered]
    n = len(texts)
    shares = np.stack(
        [np.bincount(rows, marginals[lettered, k], n) for k in range(len(langs))], axis=1
    )
    total = shares.sum(axis=1)
    best = shares.argmax(axis=1)
    score = shares[np.arange(n), best] / np.maximum(total, 1e-300)
    found = np.array(langs, dtype=object)[best]
    ascii_letters = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(_IS_LETTER[texts.data] & (texts.data < 128), out=ascii_letters[1:])
    seen = ascii_letters[texts.bounds[1:]] > ascii_letters[texts.bounds[:-1]]
    for r in np.flatnonzero(~seen):  # without a-z: look for letters of other scripts
        text = texts.data[texts.bounds[r] : texts.bounds[r + 1]].tobytes().decode("utf-8", "replace")
        if not any(char.isalpha() for char in text):
            found[r], score[r] = UNKNOWN, 1.0
    return found, score.clip(0, 1)


def label_languages(
    docs: DataFrame,
    fitted: tuple[list[str], Field] | None,
    text: str = "text",
    out_lang: str = "found_lang",
    out_score: str = "lang_score",
) -> DataFrame:
    """The table with two more columns: the language found in its text, and its share."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # 2**TABLE_BITS weights a language
    schema = StructType(
        [*docs.schema.fields, StructField(out_lang, StringType()), StructField(out_score, DoubleType())]
    )

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop, part in parts(batch.column(text)):
                if shared.value is None:
                    found, score = [UNKNOWN] * len(part), np.zeros(len(part))
                else:
                    found, score = _judged(*shared.value, part)
                rows = batch.slice(begin, stop - begin)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(found, pa.string()), pa.array(score)], names=schema.names
                )

    return docs.mapInArrow(labelled, schema)


def language_digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    return label_languages(docs.select("doc_id", "text"), fit_languages(docs)).select(
        "doc_id",
        (remainder(HOLD_OUT) == HOLD_OUT_REMAINDER).alias("held_out"),
        F.col("found_lang").alias("lang_pred"),
        F.col("lang_score").alias("score"),
    )


def keep_one_language(docs: DataFrame) -> DataFrame:
    """The documents with a language that has ``LEAST_SHARE`` of their words, columns unchanged."""
    out_lang, out_score = free_name(docs, "found_lang"), free_name(docs, "lang_score")
    labelled = label_languages(docs, fit_languages(docs), out_lang=out_lang, out_score=out_score)
    kept = labelled.where((F.col(out_lang) != UNKNOWN) & (F.col(out_score) >= LEAST_SHARE))
    return kept.drop(out_lang, out_score)
