"""Language-model scores: a hidden Markov model over the words of whole texts.

A text is its words (A-Z in lower case) and one end token.  Latent states follow each other by
learned moves; a state emits a word group, and the group emits the word by its smoothed share of
the group's training tokens: (count + 1) / (tokens + words + 1), the last 1 for all words never
seen.  The ``OWN_GROUPS`` most frequent words are groups by themselves, the others share a group by
their ending, and the end token is a group.  So the states' tables have a fixed size, while every
word of the corpus has its own count.

Training reads all training texts: word counts, then turns of Baum-Welch, whose expected counts are
summed across partitions.  Turns over a sixteenth of the texts come first, then over a quarter, then
over all; each part goes on until a turn raises its log likelihood by no more than ``SETTLED`` a
token, so most turns are short ones and the last ones see every training text.  Held-out texts take
no part.  Only the tables it starts from are fitted to a bounded sample, the ``SAMPLE_ROWS`` training
texts with the smallest hash of their id.  Texts are turned into word groups once, two bytes a token,
and the turns read those; they sum in single precision, the scores in double.

The score is the exact log10 probability of the text, from the scaled forward recursion.  Counts
of the ``SHARED_WORDS`` most frequent words go to every task; those of all others are joined.
Words are told apart by a 64-bit hash.

A null text counts as empty: it is the end token alone.  Every row is scored, repeated ones too,
and each repeated training row counts.  Extra columns don't matter; an empty table gives an empty
result; without training texts all words are unknown and all tables even.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opatlas.llm.chains import sum_paths
from opatlas.llm.tables import most_frequent, remainder, sample_texts, text_of, written
from opatlas.llm.word_arrays import Texts, Words, parts
from opatlas.session import new_shared_path

HOLD_OUT, HOLD_OUT_REMAINDER = 7, 2
STATES = 8
OWN_GROUPS, ENDINGS = 4096, 4096
END_GROUP = OWN_GROUPS + ENDINGS
GROUPS = END_GROUP + 1
SHARED_WORDS = 1 << 17
SAMPLE_ROWS, SAMPLE_TURNS = 300, 15
PART, CHUNK = 1 << 20, 1 << 19  # bytes of text, tokens
# Natural logarithm of the likelihood a token.
SETTLED = 0.001
# Sixteenths of the texts that the turns of each level read.
LEVELS = (1, 4, 16)
# Weight of the overall shares in a state's emissions, in tokens.
PRIOR = 20.0


def _is_training() -> Column:
    return remainder(HOLD_OUT) != HOLD_OUT_REMAINDER


def endings(words: Words, at: np.ndarray) -> np.ndarray:
    """Group by the last three bytes of the words at some places."""
    starts, stops = words.starts[at], words.stops[at]
    hashes = words.ranges().of(np.maximum(starts, stops - 3), stops)
    return (hashes % np.uint64(ENDINGS)).astype(np.int64) + OWN_GROUPS


@dataclass
class Lexicon:
    """What training texts hold: the most frequent words with their counts, and each group's size.

    ``words`` is sorted; the group of ``words[i]`` is ``group[i]``.  ``tokens`` and ``kinds`` are
    per group, for words only; ``texts`` counts end tokens.
    """

    words: np.ndarray
    counts: np.ndarray
    group: np.ndarray
    tokens: np.ndarray
    kinds: np.ndarray
    texts: int

    @property
    def train_tokens(self) -> int:
        return int(self.tokens.sum()) + self.texts

    @property
    def train_kinds(self) -> int:
        return int(self.kinds.sum()) + (self.texts > 0)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``words``, whether it is there)."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return at, self.words[at] == hashes


@dataclass
class Model:
    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray  # states x groups


@dataclass
class Tokens:
    """Tokens of some texts: their groups, and where each text's begin (its end token included)."""

    first: np.ndarray
    groups: np.ndarray
    words: Words
    hashes: np.ndarray  # of the distinct words
    inverse: np.ndarray
    distinct_groups: np.ndarray


def tokens_of(texts: Texts, lexicon: Lexicon) -> Tokens:
    words = texts.words()
    hashes, at, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
    place, known = lexicon.find(hashes)
    groups = endings(words, at)
    if len(lexicon.words):
        own = known & (lexicon.group[place] < OWN_GROUPS)
        groups[own] = lexicon.group[place][own]
    n = len(texts)
    first = words.first + np.arange(n + 1)
    out = np.full(first[-1], END_GROUP)
    inner = np.ones(first[-1], bool)
    inner[first[1:] - 1] = False
    out[inner] = groups[inverse]
    return Tokens(first, out, words, hashes, inverse, groups)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, ending, count) over the texts; the end token isn't among them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, part in parts(batch.column("text"), PART):
                words = part.words()
                hashes, at, times = np.unique(words.hashes(), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes.view(np.int64)),
                        pa.array(endings(words, at)),
                        pa.array(times.astype(np.int64)),
                    ],
                    ["word", "ending", "times"],
                )

    rows = docs.select(text_of().alias("text")).mapInArrow(counted, "word bigint, ending bigint, times bigint")
    return rows.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("times").alias("times"))


def read_lexicon(counts: DataFrame, texts: int) -> Lexicon:
    """``counts``: (word, ending, times), written."""
    top = most_frequent(counts, "times", SHARED_WORDS).select("word", "ending", "times").toPandas()
    top = top.sort_values(["times", "word"], ascending=[False, True])
    words = top["word"].to_numpy(np.int64).view(np.uint64)
    times, group = top["times"].to_numpy(np.int64), top["ending"].to_numpy(np.int64).copy()
    own = min(OWN_GROUPS, len(group))
    tokens, kinds = np.zeros(GROUPS), np.zeros(GROUPS)
    by_ending = counts.groupBy("ending").agg(F.sum("times").alias("tokens"), F.count("*").alias("kinds"))
    for row in by_ending.collect():  # one row an ending
        tokens[row["ending"]], kinds[row["ending"]] = row["tokens"], row["kinds"]
    np.subtract.at(tokens, group[:own], times[:own])
    np.subtract.at(kinds, group[:own], 1)
    tokens[:own], kinds[:own] = times[:own], 1
    group[:own] = np.arange(own)
    order = np.argsort(words)
    return Lexicon(words[order], times[order], group[order], tokens, kinds, texts)


def _shares(lexicon: Lexicon) -> np.ndarray:
    sizes = lexicon.tokens + 1.0
    sizes[END_GROUP] = lexicon.texts + 1.0
    return sizes / sizes.sum()


def expected(model: Model, first: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, float]:
    """Expected counts of starts, moves and emissions in one array, and the log likelihood."""
    summed = sum_paths(first, model.emits.T.astype(np.float32), model.start, model.moves, codes=groups)
    counts = [summed.starts, summed.pairs.ravel(), summed.marginals.T.ravel()]
    return np.concatenate(counts), float(summed.log_sum.sum())


def maximised(sums: np.ndarray, shares: np.ndarray, k: int) -> Model:
    start = sums[:k] + 1.0
    moves = sums[k : k + k * k].reshape(k, k) + 1.0
    emits = sums[k + k * k :].reshape(k, GROUPS) + PRIOR * shares
    return Model(
        start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=1, keepdims=True)
    )


def first_model(docs: DataFrame, lexicon: Lexicon, k: int = STATES) -> Model:
    """Tables fitted to a bounded sample of the training texts, from a random start."""
    shares = _shares(lexicon)
    rng = np.random.Generator(np.random.PCG64(11))
    emits = shares * rng.gamma(1.0, size=(k, GROUPS)) + shares * 0.1
    moves = np.eye(k) * 4 + rng.random((k, k))
    model = Model(
        np.full(k, 1 / k), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=1, keepdims=True)
    )
    column = pa.array(sample_texts(docs, SAMPLE_ROWS), pa.large_string())
    for _, _, part in parts(column, most=1 << 62):
        tokens = tokens_of(part, lexicon)
        for _ in range(SAMPLE_TURNS):
            model = maximised(expected(model, tokens.first, tokens.groups)[0], shares, k)
    return model


def _grouped(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(level, groups): the word groups of each text, its end token included, as 16-bit numbers.

    Stored by level, so a turn reads the files of its levels only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in batches:
            for begin, _, part in parts(batch.column("text"), PART):
                tokens = tokens_of(part, lexicon)
                buffers = [None, pa.py_buffer((tokens.first * 2).astype(np.int64)), pa.py_buffer(tokens.groups.astype(np.int16))]
                groups = pa.Array.from_buffers(pa.large_binary(), len(part), buffers).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("level").slice(begin, len(part)), groups], ["level", "groups"]
                )

    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(LEVELS[-1]))
    level = F.when(share < LEVELS[0], 0).when(share < LEVELS[1], 1).otherwise(2)
    rows = docs.select(level.alias("level"), text_of().alias("text")).mapInArrow(grouped, "level int, groups binary")
    path = new_shared_path(docs.sparkSession, "word-groups")
    rows.write.partitionBy("level").parquet(path)
    return docs.sparkSession.read.schema("groups binary, level int").parquet(path)


def _chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first, groups) of whole texts, about ``CHUNK`` tokens at a time."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 2
    groups = np.frombuffer(column.buffers()[2], np.int16, count=int(ends[-1]))
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
        yield ends[at : stop + 1] - ends[at], groups[ends[at] : ends[stop]].astype(np.int64)
        at = stop


def trained(docs: DataFrame, lexicon: Lexicon, model: Model, passes: int | None = None) -> Model:
    """Baum-Welch over ``docs``: each turn sums expected counts across the partitions.

    Given a number of ``passes``, so many turns read all texts; else they go on until they settle.
    """
    shares, k = _shares(lexicon), len(model.start)
    context = docs.sparkSession.sparkContext
    size = k + k * k + k * GROUPS
    rows = _grouped(docs, lexicon)

    def turn(model: Model, level: int) -> tuple[np.ndarray, float, float]:
        """Expected counts, log likelihood and number of tokens of the texts up to a level."""
        shared = context.broadcast(model)

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            total = np.zeros(size + 2)
            for batch in batches:
                for first, groups in _chunks(batch.column("groups")):
                    counts, logs = expected(model, first, groups)
                    total[:size] += counts
                    total[size:] += logs, len(groups)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "value"])

        read = rows.where(F.col("level") <= level).select("groups")
        found = read.mapInArrow(summed, "slot bigint, value double")
        found = found.groupBy("slot").agg(F.sum("value").alias("value")).toPandas()  # ``size`` numbers
        shared.destroy()
        sums = np.zeros(size + 2)
        sums[found["slot"].to_numpy()] = found["value"].to_numpy()
        return sums[:size], float(sums[size]), float(sums[size + 1])

    if passes is not None:
        for _ in range(passes):
            model = maximised(turn(model, len(LEVELS) - 1)[0], shares, k)
        return model
    for level in range(len(LEVELS)):
        before = -np.inf
        while True:
            sums, logs, tokens = turn(model, level)
            if not tokens or logs / tokens - before <= SETTLED:
                break
            before = logs / tokens
            model = maximised(sums, shares, k)
    return model


def _scored(docs: DataFrame, lexicon: Lexicon, model: Model) -> DataFrame:
    """A row for each text: what the shared tables say of it, and its other words."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, model))
    schema = (
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, "
        "path double, others binary, times binary"
    )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model = shared.value
        log_counts = np.log10(lexicon.counts + 1.0)
        in_group = np.log10(lexicon.tokens + lexicon.kinds + 1.0)
        for batch in batches:
            for begin, stop, part in parts(batch.column("text"), PART):
                tokens = tokens_of(part, lexicon)
                summed = sum_paths(
                    tokens.first, model.emits.T, model.start, model.moves, marginals=False, codes=tokens.groups
                )
                place, known = lexicon.find(tokens.hashes)
                if len(lexicon.words):
                    log_count = np.where(known, log_counts[place], 0.0)
                else:
                    log_count = np.zeros(len(known))
                first, rows, n = tokens.words.first, tokens.words.rows(), len(part)
                at = tokens.inverse
                logs = np.bincount(rows, log_count[at], n)
                groups = np.bincount(rows, in_group[tokens.distinct_groups][at], n)
                others, times = [], []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    own = at[a:b]
                    rare, often = np.unique(own[~known[own]], return_counts=True)
                    others.append(tokens.hashes[rare].tobytes())
                    times.append(often.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(begin, n),
                        batch.column("held_out").slice(begin, n),
                        pa.array(np.diff(first) + 1),
                        pa.array(np.bincount(rows, known[at], n).astype(np.int64)),
                        pa.array(logs),
                        pa.array(summed.log_sum / np.log(10) - groups),
                        pa.array(others, pa.binary()),
                        pa.array(times, pa.binary()),
                    ],
                    [c.split()[0] for c in schema.split(", ")],
                )

    held_out = ~_is_training()
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), text_of().alias("text")
    ).mapInArrow(scored, schema)


def _other_words(scored: DataFrame) -> DataFrame:
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy()
            words = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column("others")]
            times = [np.frombuffer(v.as_buffer(), np.int32) for v in batch.column("times")]
            if words:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(rows, [len(w) for w in words])),
                        pa.array(np.concatenate(words)),
                        pa.array(np.concatenate(times)),
                    ],
                    ["row", "word", "often"],
                )

    return scored.select("row", "others", "times").mapInArrow(listed, "row bigint, word bigint, often int")


def score_texts(docs: DataFrame) -> DataFrame:
    """Every row's base score and model score, learned from the rows that aren't held out."""
    training = docs.select("doc_id", "text").where(_is_training())
    counts = written(count_words(training), "word-counts")
    lexicon = read_lexicon(counts, training.count())
    model = trained(training, lexicon, first_model(training, lexicon))
    rows = _scored(docs, lexicon, model).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "scored-texts")  # the row numbers are fixed from here on
    log_count = F.log10(F.col("times") + 1)
    of_others = (
        _other_words(rows).join(counts.select("word", "times"), "word")
        .groupBy("row")
        .agg(F.sum("often").alias("more_known"), F.sum(F.col("often") * log_count).alias("more_logs"))
    )
    n, v = lexicon.train_tokens, lexicon.train_kinds
    end = float(np.log10(lexicon.texts + 1.0))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return rows.drop("others", "times").join(of_others, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + int(lexicon.texts > 0)).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (logs + end - F.col("n_tokens") * float(np.log10(n + v + 1.0))).alias("base_score"),
        (F.col("path") + logs).alias("score"),
    )
