from __future__ import annotations

import random
import zlib
from pathlib import Path

import cases
import numpy as np
import pytest

pytest.importorskip("opatlas.llm")
import public_tokenizers  # noqa: E402
from opatlas.llm import packing  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(3)
    pool = ["a", "B", " ", "  ", "\n", "\t", "é", "日本", "😀", "​", "\xa0", "1", "٣", "'s", "'ll", "<|endoftext|>", "<|", ".", "!!"]
    encoder = packing.Encoder()
    for _ in range(500):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
        assert encoder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("white", [" ", "\n"])
def test_long_white_space(tokenizer, white):
    text = "hello" + white * 1_500_000 + "world"
    assert packing.Encoder().ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 2047, 2048, 2049, 5000])
def test_pieces(n):
    pieces = packing.cut(np.arange(n, dtype="<u4"))
    assert [len(p) for _, p in pieces][1:] == [1024] * (len(pieces) - 1)
    assert len(pieces) == -(-n // 1024)
    assert np.concatenate([p for _, p in pieces]).tolist() == list(range(n))
    assert [s for s, _ in pieces] == list(np.cumsum([0, *[len(p) for _, p in pieces]])[:-1])


@pytest.mark.parametrize("n", [3, 200, 20_000])
def test_plan_places_all_and_wastes_little(n):
    rng = np.random.default_rng(n)
    lengths = np.clip(rng.lognormal(5.5, 1.2, n).astype(int), 1, 1024)
    histogram = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))
    plan = packing.plan(histogram, rounds=60)
    placed = {}
    for found, times in plan:
        assert sum(length * c for length, c in found) <= 1024
        for length, c in found:
            placed[length] = placed.get(length, 0) + c * times
    assert placed == histogram
    assert sum(t for _, t in plan) <= -(-int(lengths.sum()) // 1024) * 1.02 + 1


def histogram_of(lengths):
    return dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))


@pytest.mark.parametrize("copies", [20, 200, 2000])
def test_the_program_makes_the_plan(copies):
    rng = np.random.default_rng(copies)
    own = histogram_of(np.clip(rng.lognormal(5.5, 1.2, 900).astype(int), 1, 1023))
    histogram = {n: c * copies for n, c in own.items()}
    used = packing.program(histogram, 1024)
    placed = {}
    for found, times in used:
        assert times > 0 and sum(n * c for n, c in found) <= 1024
        for n, c in found:
            placed[n] = placed.get(n, 0) + c * times
    assert all(c <= histogram[n] for n, c in placed.items())
    share = sum(placed.values()) / sum(histogram.values())
    assert share >= 0.9
    plan = packing.plan(histogram)
    assert sorted(plan) != sorted(packing.plan(histogram, rounds=0))
    bound = -(-sum(n * c for n, c in histogram.items()) // 1024)
    assert bound <= sum(t for _, t in plan) <= bound + len(histogram)


def test_the_program_places_most_pieces_of_the_given_table(spark):
    path = "/root/testdata/sf0.1/documents.parquet"
    if not Path(path).exists():
        pytest.skip("test tables are not here")
    lengths = packing.tokenised(spark.read.parquet(path)).select("length").toPandas().length.to_numpy()
    histogram = histogram_of(lengths[lengths < 1024])
    placed = sum(c * t for found, t in packing.program(histogram, 1024) for _, c in found)
    assert placed >= 0.9 * sum(histogram.values())
    sequences = sum(t for _, t in packing.plan(histogram))
    assert sequences <= -(-sum(n * c for n, c in histogram.items()) // 1024) + len(histogram)


def test_best_configuration_is_the_best():
    rng = random.Random(1)
    for _ in range(30):
        lengths = np.array(sorted(rng.sample(range(2, 30), 5)))
        prices = np.array([rng.random() for _ in lengths])
        found = packing.best_configuration(lengths, prices, 40)
        price = dict(zip(lengths.tolist(), prices, strict=True))
        best = [0.0] * 41
        for room in range(1, 41):
            best[room] = max([best[room - 1], *[best[room - n] + price[n] for n in price if n <= room]])
        assert sum(n * c for n, c in found) <= 40
        assert sum(price[n] * c for n, c in found) == pytest.approx(best[40])


def test_documents_are_packed_whole(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 50)
    monkeypatch.setattr(packing, "ROUNDS", 60)
    rows = [r for r in cases.documents() if r[0] is not None and r[0] != 7]
    got = packing.pack_documents(cases.frame(spark, rows, clashing=True)).toPandas()
    texts = {i: t for i, t, *_ in rows}
    want = {}
    for doc_id, text in texts.items():
        want[doc_id] = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
    for doc_id, own in got.drop_duplicates(["doc_id", "piece"]).sort_values("piece").groupby("doc_id"):
        ids = want.pop(doc_id)
        assert own.length.sum() == len(ids) and own.piece.tolist() == list(range(len(own)))
        for r in own.itertuples():
            piece = np.array(ids[r.start : r.start + r.length], "<u4")
            assert zlib.crc32(piece.tobytes()) == r.ids_crc32
    assert not want
    assert len(got[got.doc_id == rows[5][0]]) == 3 * got[got.doc_id == rows[5][0]].piece.nunique()
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
    assert placed.groupby("sequence_id").length.sum().max() <= 1024
    assert placed.sequence_id.nunique() <= -(-got.length.sum() // 1024) * 1.05 + 1


def test_empty_table(spark):
    assert packing.pack_documents(cases.frame(spark, [])).count() == 0
