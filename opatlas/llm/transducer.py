"""Encoding and decoding with a SentencePiece vocabulary, as a weighted finite-state transducer.

The transducer is compiled from a model file: its normaliser (a space becomes the mark U+2581, one
mark is put before a text), an arc for each piece with its weight, and byte fallback, which spells a
character without a piece as its UTF-8 bytes.  The model's pieces come from merging neighbours, the
best score first, so its states remember the last piece: an arc from piece to piece is there only if
merging would leave the two side by side.  Composed with a text it is a lattice; the encoding is the
lattice's shortest path in the tropical semiring.  By the pair rule just one piece that ends at a
place has a path to it, so the least weight there is that piece's, and the result is the library's:
no weight needs to be added or compared.  Unigram models are refused, as are normalisers with a
character map or with removal of extra white space; user-defined pieces are not used.

No piece holds a mark after another character, so a path always passes between a word and the mark
after it.  The lattice therefore falls apart into words with their leading marks, each distinct word
of a part is composed once, and the paths of all words are searched side by side.

A null or empty text has no pieces.  Decoding gives back the text, except that marks in it come
back as spaces.  Repeated rows are encoded alike, extra columns don't matter, an empty table gives
an empty result, and words of any length are handled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opatlas.llm.tables import text_of
from opatlas.llm.word_arrays import RangeHashes, Texts, mixed, parts

MODEL = "piece_bpe_32k.model"
MARK = 0x2581
PART = 1 << 20
# Words up to this length are searched side by side, longer ones one by one.
SIDE_BY_SIDE = 64
_SLOT_BITS = 20


class Table:
    """Places of 64-bit keys, looked up many at once."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.probes = keys, 1
        self.slots = np.full((1 << _SLOT_BITS) + 64, -1, np.int32)
        for i, slot in enumerate(self._slot(keys).tolist()):
            probe = 0
            while self.slots[slot + probe] >= 0:
                probe += 1
            self.slots[slot + probe] = i
            self.probes = max(self.probes, probe + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where there is none."""
        slot = self._slot(keys)
        found = self.slots[slot]
        open_ = np.flatnonzero(found >= 0)
        for probe in range(1, self.probes + 1):
            open_ = open_[self.keys[found[open_]] != keys[open_]]
            if not len(open_):
                break
            found[open_] = self.slots[slot[open_] + probe] if probe < self.probes else -1
            open_ = open_[found[open_] >= 0]
        return found


def _pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64))


class Transducer:
    """Arcs of a model.  Arcs are numbered single characters first, then by falling score."""

    def __init__(self, model: str | None = None) -> None:
        import public_tokenizers
        from sentencepiece import sentencepiece_model_pb2 as messages

        proto = messages.ModelProto()
        with open(model or public_tokenizers.path(MODEL), "rb") as file:
            proto.ParseFromString(file.read())
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError(f"normaliser {rules.name!r} isn't supported")
        if proto.trainer_spec.model_type != messages.TrainerSpec.BPE:
            raise ValueError("only models whose pieces come from merges are supported")
        self.prefix = rules.add_dummy_prefix
        kinds = messages.ModelProto.SentencePiece
        self.byte_ids = np.full(256, -1, np.int64)
        normal = []
        self.spelling: list[bytes] = []
        for number, piece in enumerate(proto.pieces):
            if piece.type == kinds.BYTE:
                value = int(piece.piece[1:-1], 16)
                self.byte_ids[value] = number
                self.spelling.append(bytes([value]))
            elif piece.type == kinds.NORMAL:
                normal.append((len(piece.piece) > 1, -piece.score, number, piece.piece))
                self.spelling.append(piece.piece.replace(chr(MARK), " ").encode())
            else:
                self.spelling.append(b"")
        normal.sort()
        self._compile_merges([text for _, _, _, text in normal])
        reached = [i for i, (left, _) in enumerate(self.splits) if left >= 0]
        letters = [np.array([ord(c) for c in normal[i][3]], np.uint32) for i in reached]
        if any((own[1:][own[:-1] != MARK] == MARK).any() for own in letters):
            raise ValueError("a piece holds a mark after another character")
        self.longest = max(map(len, letters))
        stops = np.cumsum([len(own) for own in letters])
        joined = np.concatenate(letters)
        self.arcs = Table(RangeHashes(joined).of(np.concatenate([[0], stops[:-1]]), stops))
        self.arc_number = np.append(np.array(reached, np.int32), -1)
        self.ids = np.array([number for _, _, number, _ in normal], np.int64)
        self.lengths = np.array([len(s) for s in self.spelling])
        self.spelled = np.frombuffer(b"".join(self.spelling), np.uint8)
        self.begins = np.cumsum(self.lengths) - self.lengths

    def _compile_merges(self, texts: list[str]) -> None:
        """Which two arcs merging makes each arc from; (-1, -1) where it never comes about."""
        number = {text: i for i, text in enumerate(texts)}
        self.splits: list[tuple[int, int]] = []
        self.merges: dict[tuple[int, int], int] = {}
        for i, text in enumerate(texts):
            found = (i, i) if len(text) == 1 else (-1, -1)
            for at in range(1, len(text)):
                left, right = number.get(text[:at], i), number.get(text[at:], i)
                if left < i and right < i and min(self.splits[left][0], self.splits[right][0]) >= 0:
                    if self.side_by_side(left, right):
                        found = (left, right)
                        self.merges[found] = i
                        break
            self.splits.append(found)
        self.lefts = np.array([left for left, _ in self.splits])
        self.rights = np.array([right for _, right in self.splits])
        pairs = np.array(list(self.merges))
        self.pairs = Table(_pair_keys(pairs[:, 0], pairs[:, 1]))
        self.merged = np.append(np.array(list(self.merges.values())), 1 << 40)

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether merging the letters of two arcs ends in just these two.

        The merges that made them are undone, the latest first; before each, no merge across the
        border may have come earlier.
        """
        limit = 1 << 40
        while True:
            if self.merges.get((left, right), limit) < limit:
                return False
            right_first = left <= right
            for _ in range(2):
                if right_first:
                    limit, right = right + 1, self.splits[right][0]
                    whole = right + 1 == limit
                else:
                    limit, left = left, self.splits[left][1]
                    whole = left == limit
                if not whole:
                    break
                right_first = not right_first
            if whole:
                return True

    def all_side_by_side(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``side_by_side`` for many pairs; an arc of -1 (a border or spelled bytes) goes with all."""
        out = (left < 0) | (right < 0)
        open_ = np.flatnonzero(~out)
        a, b = left[open_].astype(np.int64), right[open_].astype(np.int64)
        limit = np.full(len(open_), 1 << 40)
        while len(open_):
            kept = self.merged[self.pairs.find(_pair_keys(a, b))] >= limit
            open_, a, b, limit = open_[kept], a[kept], b[kept], limit[kept]
            next_a, next_b = self.rights[a], self.lefts[b]
            undo_b = (a <= b) & (next_b != b)
            undo_a = (a > b) & (next_a != a)
            neither = ~undo_a & ~undo_b  # the later one is a single character: undo the other
            undo_a |= neither & (a <= b) & (next_a != a)
            undo_b |= neither & (a > b) & (next_b != b)
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, next_a, a), np.where(undo_b, next_b, b)
            whole = ~undo_a & ~undo_b
            out[open_[whole]] = True
            open_, a, b, limit = open_[~whole], a[~whole], b[~whole], limit[~whole]
        return out

    # encoding

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(first, ids): text r has ids[first[r]:first[r+1]]."""
        points, first = self._normalised(texts)
        cuts = np.flatnonzero(_cuts(points, first))
        stops = np.append(cuts[1:], len(points))
        keys = RangeHashes(points).of(cuts, stops)
        _, at, word = np.unique(keys, return_index=True, return_inverse=True)
        lengths = (stops - cuts)[at]
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at, lengths, word = at[order], lengths[order], rank[word]
        starts = np.cumsum(lengths) - lengths
        letters = points[np.repeat(cuts[at] - starts, lengths) + np.arange(lengths.sum())]
        begin, counts, ids = self._paths(letters, starts, lengths)
        sizes = counts[word]
        out = ids[np.repeat(begin[word] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        of_words = np.concatenate([[0], np.cumsum(sizes)])
        return of_words[np.searchsorted(cuts, first)], out

    def _normalised(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        raw = texts.data.tobytes().decode("utf-8").encode("utf-32-le")
        points = np.frombuffer(raw, np.uint32).copy()
        leads = np.zeros(len(texts.data) + 1, np.int64)
        np.cumsum((texts.data & 0xC0) != 0x80, out=leads[1:])
        first = leads[texts.bounds]
        points[points == 32] = MARK
        if self.prefix:
            some = np.diff(first) > 0
            points = np.insert(points, first[:-1][some], MARK)
            first = first + np.concatenate([[0], np.cumsum(some)])
        return points, first

    def _paths(self, letters, starts, lengths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shortest paths of words, longest first: (begin, count) into ids."""
        n, longest = len(letters), self.longest
        place = np.arange(n) - np.repeat(starts, lengths)
        arcs = np.full((n, longest), -1, np.int32)  # by last letter and length
        hashes = RangeHashes(letters)
        for size in range(1, longest + 1):
            ends = np.flatnonzero(place >= size - 1)
            arcs[ends, size - 1] = self.arc_number[self.arcs.find(hashes.of(ends - size + 1, ends + 1))]
        size_in_bytes = 1 + (letters >= 0x80) + (letters >= 0x800) + (letters >= 0x10000)
        back = np.ones(n, np.int64)  # length of the last piece of the path to each letter
        last = np.full(n, -1, np.int32)  # and its arc
        short = int(np.searchsorted(-lengths, -SIDE_BY_SIDE))  # words before it are longer
        for w in range(short):
            self._one_path(arcs, int(starts[w]), int(lengths[w]), back, last)
        widest = int(lengths[short]) if short < len(lengths) else 0
        for t in range(widest):
            active = int(np.searchsorted(-lengths[short:], -t))
            ends = starts[short : short + active] + t
            which, size = np.nonzero(arcs[ends][:, : t + 1] >= 0)
            at = ends[which]
            arc = arcs[at, size]
            before = np.where(size < t, last[np.maximum(at - size - 1, 0)], -1)
            ok = self.all_side_by_side(before, arc)
            back[at[ok]], last[at[ok]] = size[ok] + 1, arc[ok]
        # walk back along all paths at once
        pieces_at: list[np.ndarray] = []
        words_at: list[np.ndarray] = []
        walking, end = np.arange(len(lengths)), starts + lengths - 1
        while len(walking):
            pieces_at.append(end.copy())
            words_at.append(walking)
            end = end - back[end]
            on = end >= starts[walking]
            walking, end = walking[on], end[on]
        if not pieces_at:
            none = np.zeros(0, np.int64)
            return none, none, none
        ends, word = np.concatenate(pieces_at), np.concatenate(words_at)
        order = np.argsort(ends, kind="stable")  # words come in order, and so do their pieces
        ends, word = ends[order], word[order]
        arc = last[ends]
        spelled = arc < 0
        sizes = np.where(spelled, size_in_bytes[ends], 1)
        ids = np.repeat(np.where(spelled, -1, self.ids[arc]), sizes)
        if spelled.any():
            text = letters[ends[spelled]].astype("<u4").tobytes().decode("utf-32-le").encode()
            ids[np.repeat(spelled, sizes)] = self.byte_ids[np.frombuffer(text, np.uint8)]
        counts = np.bincount(word, sizes, len(lengths)).astype(np.int64)
        return np.cumsum(counts) - counts, counts, ids

    def _one_path(self, arcs, start: int, length: int, back: np.ndarray, last: np.ndarray) -> None:
        """One long word's path, letter by letter."""
        for low in range(0, length, 4096):
            rows = arcs[start + low : start + min(length, low + 4096)].tolist()
            for t, row in enumerate(rows, low):
                for size, arc in enumerate(row[: t + 1]):
                    if arc >= 0:
                        before = int(last[start + t - size - 1]) if size < t else -1
                        if before < 0 or self.side_by_side(before, arc):
                            back[start + t], last[start + t] = size + 1, arc

    # decoding

    def decode(self, first: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, bytes) of the texts; the space of the text's first mark is taken away."""
        sizes = self.lengths[ids]
        data = self.spelled[np.repeat(self.begins[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        bounds = np.concatenate([[0], np.cumsum(sizes)])[first]
        if self.prefix:
            some = np.diff(bounds) > 0
            heads = bounds[:-1][some]
            heads = heads[data[heads] == 32]
            dropped = np.zeros(len(data) + 1, np.int64)
            dropped[heads + 1] = 1
            data = np.delete(data, heads)
            bounds = bounds - np.cumsum(dropped)[bounds]
        return bounds, data


def _cuts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a word begins at each place: at a text's first, and at marks after other characters."""
    begins = np.zeros(len(points), bool)
    if len(points):
        begins[1:] = (points[1:] == MARK) & (points[:-1] != MARK)
        begins[first[:-1][np.diff(first) > 0]] = True
    return begins


def encode(docs: DataFrame, model: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """(doc_id, ids) of every row."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(model)
        for batch in batches:
            for begin, _, part in parts(batch.column("text"), PART):
                first, ids = machine.encode(part)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, len(part)), lists], ["doc_id", out]
                )

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    return source.mapInArrow(encoded, f"doc_id bigint, `{out}` array<int>")


def decode(encoded: DataFrame, model: str | None = None, ids: str = "ids", out: str = "text") -> DataFrame:
    """(doc_id, text) of rows with ids; null ids give an empty text, bytes that aren't UTF-8 U+FFFD."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(model)
        for batch in batches:
            lists = batch.column("ids")
            sizes = np.array([0 if v is None else v for v in pa.compute.list_value_length(lists).to_pylist()])
            bounds, data = machine.decode(
                np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
                lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
            )
            texts = [
                data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", out])

    source = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(ids).alias("ids"))
    return source.mapInArrow(decoded, f"doc_id bigint, `{out}` string")


def encoding_digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, checksum of the ids, and whether decoding gave the text back."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(model)
        for batch in batches:
            for begin, _, part in parts(batch.column("text"), PART):
                first, ids = machine.encode(part)
                bounds, data = machine.decode(first, ids)
                small = ids.astype("<u4")
                same, sums = [], []
                for r in range(len(part)):
                    want = part.data[part.bounds[r] : part.bounds[r + 1]].tobytes()
                    got = data[bounds[r] : bounds[r + 1]].tobytes()
                    same.append(got == want or got == want.replace(chr(MARK).encode(), b" "))
                    sums.append(zlib.crc32(small[first[r] : first[r + 1]].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(begin, len(part)),
                        pa.array(np.diff(first).astype(np.int64)),
                        pa.array(sums, pa.int64()),
                        pa.array(same, pa.bool_()),
                    ],
                    ["doc_id", "n_pieces", "ids_crc32", "round_trip"],
                )

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return source.mapInArrow(digested, "doc_id bigint, n_pieces bigint, ids_crc32 bigint, round_trip boolean")
