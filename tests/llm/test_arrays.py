"""Word arrays, runs and chain sums against plain loops."""

from __future__ import annotations

import itertools
import random

import cases
import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("opatlas.llm")
from opatlas.llm.chains import BLOCK, by_brute_force, sum_paths  # noqa: E402
from opatlas.llm.runs import runs  # noqa: E402
from opatlas.llm.word_arrays import parts  # noqa: E402


def test_words_of_texts():
    texts = [t for _, t, *_ in cases.documents()]
    seen = {}
    at = 0
    for begin, stop, part in parts(pa.array(texts, pa.string()), most=5000):
        assert begin == at
        at = stop
        own = part.words()
        hashes = own.hashes()
        for r, text in enumerate(texts[begin:stop]):
            places = range(own.first[r], own.first[r + 1])
            found = [own.data[own.starts[i] : own.stops[i]].tobytes().decode() for i in places]
            assert found == cases.words(cases.lower(text))
            for word, code in zip(found, hashes[own.first[r] : own.first[r + 1]], strict=True):
                assert seen.setdefault(word, code) == code
    assert at == len(texts)
    assert len(set(seen.values())) == len(seen)


def test_runs_of_batches():
    rng = random.Random(1)
    for _ in range(300):
        keys = sorted(rng.choices(range(5), k=rng.randint(0, 12)))
        batches, i = [], 0
        while i < len(keys):
            n = rng.randint(0, 4)
            batches.append(pa.RecordBatch.from_pydict({"k": pa.array(keys[i : i + n], pa.int64())}))
            i += n
        got = [r.column("k").to_pylist() for r in runs(iter(batches), "k")]
        assert got == [list(g) for _, g in itertools.groupby(keys)]


@pytest.mark.parametrize("k", [2, 3, 5])
def test_sums_over_paths(k):
    rng = np.random.default_rng(k)
    lengths = np.array([0, 1, 2, BLOCK - 1, BLOCK, BLOCK + 1, 2 * BLOCK, 500, 3, 0, 7])
    first = np.concatenate([[0], np.cumsum(lengths)])
    weights = np.exp(rng.normal(size=(first[-1], k)) * 3)
    start, moves = rng.random(k) * 2, rng.random((k, k)) + 0.01
    got = sum_paths(first, weights, start, moves)
    assert np.allclose(got.log_sum, np.where(lengths > 0, by_brute_force(first, weights, start, moves), 0), rtol=1e-9)
    ahead, behind, pairs = np.empty_like(weights), np.empty_like(weights), np.zeros((k, k))
    for a, b in zip(first[:-1], first[1:], strict=True):
        for t in range(a, b):
            x = (start if t == a else ahead[t - 1] @ moves) * weights[t]
            ahead[t] = x / x.sum()
        for t in range(b - 1, a - 1, -1):
            x = np.ones(k) if t == b - 1 else moves @ (weights[t + 1] * behind[t + 1])
            behind[t] = x / x.sum()
        for t in range(a + 1, b):
            x = ahead[t - 1][:, None] * moves * (weights[t] * behind[t])[None]
            pairs += x / x.sum()
    both = ahead * behind
    assert np.allclose(got.marginals, both / both.sum(axis=1, keepdims=True))
    assert np.allclose(got.pairs, pairs)


def test_sequences_of_one_block_take_no_transfer_matrices():
    """Many short sequences beside a long one: matrices are kept for the long one only."""
    import tracemalloc

    rng, k = np.random.default_rng(1), 16
    lengths = np.array([3] * 20_000 + [3 * BLOCK])
    first = np.concatenate([[0], np.cumsum(lengths)])
    weights, start, moves = rng.random((first[-1], k)) + 0.01, rng.random(k), rng.random((k, k))
    tracemalloc.start()
    got = sum_paths(first, weights, start, moves, marginals=False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    some = np.array([0, 3, 6])
    assert np.allclose(got.log_sum[:2], by_brute_force(some, weights[:6], start, moves))


@pytest.mark.parametrize("kind", [float, np.float32])
def test_codes_stand_for_their_weights(kind):
    """Sums over a table's rows, by code, equal those over the rows written out place by place."""
    rng, k = np.random.default_rng(5), 4
    lengths = np.array([0, 1, 2 * BLOCK + 3, 70, 0, 5, 64, 65])
    first = np.concatenate([[0], np.cumsum(lengths)])
    table, codes = (rng.random((30, k)) + 0.01).astype(kind), rng.integers(0, 29, first[-1])
    start, moves = rng.random(k) + 0.1, rng.random((k, k)) + 0.01
    plain, coded = sum_paths(first, table[codes], start, moves), sum_paths(first, table, start, moves, codes=codes)
    tolerance = 1e-9 if kind is float else 1e-4
    assert np.allclose(plain.log_sum, coded.log_sum, rtol=tolerance)
    assert np.allclose(plain.pairs, coded.pairs, rtol=tolerance)
    assert np.allclose(coded.starts, plain.marginals[first[:-1][lengths > 0]].sum(axis=0), rtol=tolerance)
    summed = np.zeros((30, k))
    np.add.at(summed, codes, plain.marginals)
    assert np.allclose(coded.marginals, summed, rtol=tolerance)
    nothing = sum_paths(np.array([0, 0]), table, start, moves, codes=codes[:0])
    assert nothing.log_sum.tolist() == [0.0] and not nothing.marginals.any() and not nothing.pairs.any()
