from __future__ import annotations

import random

import cases
import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("opatlas.llm")
import public_tokenizers  # noqa: E402
from opatlas.llm import transducer  # noqa: E402
from opatlas.llm.word_arrays import parts  # noqa: E402
from sentencepiece import SentencePieceProcessor  # noqa: E402


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def machine():
    return transducer.Transducer()


def encoded(machine, texts):
    out = []
    for _, _, part in parts(pa.array(texts, pa.string())):
        first, ids = machine.encode(part)
        out += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def test_shortest_paths_are_the_librarys_pieces(machine, library):
    rng = random.Random(2)
    pool = ["a", "b", "aa", "the", " ", "  ", "    ", "\n", "é", "日", "😀", "▁", ".", "ing", "er", "0", "12", "�", "\x00", "ﬁ"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    texts += ["", " ", "a" * 3000, " " * 500, "abcdefgh" * 700, "the" * 900, "word " * 3000]
    texts += [t for _, t, *_ in cases.documents() if t]
    assert encoded(machine, texts) == library.encode(texts)


def test_pairs_alone_and_together(machine):
    rng = np.random.default_rng(1)
    left, right = (rng.integers(-1, len(machine.splits), 4000) for _ in range(2))
    want = [a < 0 or b < 0 or machine.side_by_side(int(a), int(b)) for a, b in zip(left, right, strict=True)]
    assert machine.all_side_by_side(left, right).tolist() == want


def test_round_trip_and_digest(spark, library):
    rows = cases.documents()
    docs = cases.frame(spark, rows, clashing=True)
    digest = transducer.encoding_digest(docs).collect()
    assert len(digest) == len(rows) and all(r.round_trip for r in digest)
    back = {r.doc_id: r.text for r in transducer.decode(transducer.encode(docs)).collect() if r.doc_id not in (None, 7)}
    assert back == {i: t or "" for i, t, *_ in rows if i not in (None, 7)}
    count = {r.doc_id: r.n_pieces for r in digest if r.doc_id not in (None, 7)}
    assert count == {i: len(library.encode(t or "")) for i, t, *_ in rows if i not in (None, 7)}


def test_empty_table(spark):
    assert transducer.encoding_digest(cases.frame(spark, [])).count() == 0
