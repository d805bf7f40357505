from __future__ import annotations

import math
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("opatlas.llm")
from opatlas.llm import whitening  # noqa: E402

COLUMNS = "vec_id bigint, embedding array<float>, label string"


def spread(values, seed=0):
    """A symmetric table with these eigenvalues."""
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    table = (q * np.array(values)) @ q.T
    return (table + table.T) / 2


@pytest.mark.parametrize("seed", range(20))
def test_inertia_counts_positive_eigenvalues(seed):
    rng = np.random.default_rng(seed)
    table = rng.standard_normal((12, 12)) * 10.0 ** rng.integers(-6, 6)
    table = table + table.T
    if seed % 2:
        np.fill_diagonal(table, 0)
    assert whitening.positive_pivots(table) == int((np.linalg.eigvalsh(table) > 0).sum())
    assert whitening.positive_pivots(np.zeros((3, 3))) == 0


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 40, 40),
        10.0 ** -np.arange(20.0),
        [5.0] * 10 + [1.0] * 10,
        [3, 3 + 1e-9, 3 - 1e-9, 2, 1, 1, 1e-7],
        [7.0] + [1.0] * 30,
        [4.0, 2.0, 0, 0, 0],
        np.random.default_rng(1).gamma(2.0, 50, 64),
    ],
)
def test_leading_vectors(values):
    table = spread(values)
    found, vectors = whitening.Spectrum(table).leading(16)
    want, _ = np.linalg.eigh(table)
    want = want[::-1]
    size = want[0]
    assert len(found) == min(16, int((want > 8 * len(want) * np.finfo(float).eps * np.abs(table).sum(1).max()).sum()))
    assert np.abs(found - want[: len(found)]).max() <= 1e-12 * size
    assert (np.diff(found) <= 1e-12 * size).all()
    assert np.abs(table @ vectors - vectors * found).max() <= 1e-12 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() <= 1e-11


def test_nothing_to_find():
    assert whitening.Spectrum(np.zeros((5, 5))).leading(16)[0].tolist() == []


def rows_of(seed=3, n=300, d=20):
    rng = np.random.default_rng(seed)
    plain = (rng.standard_normal((n, d)) * np.linspace(0.3, 2, d)).astype(np.float32)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(plain)]
    rows += [(900 + i, plain[0].tolist(), "hot") for i in range(150)]
    rows += [(5, plain[5].tolist(), None), (None, plain[9].tolist(), None)]
    near = plain[7].copy()
    near[0] = np.nextafter(near[0], np.float32(9))  # another vector, the same whole numbers
    rows += [(2000, near.tolist(), "x")]
    odd = [(3000, None, "x"), (3001, [None] * d, "x"), (3002, [1.0] * (d - 1) + [float("nan")], "x"), (3003, [], "x")]
    odd += [(3004, [1.0] * (d - 1) + [float("inf")], "x"), (3005, [1.0] * (d - 1), "x"), (3006, [1e30] * d, "x")]
    return rows, odd


def plain_whitening(rows):
    x = {tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for _, v, _ in rows}
    n = len(x)
    sums = [sum(column) for column in zip(*x, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    table = centred.T @ centred / n
    values, vectors = np.linalg.eigh(table)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    out = defaultdict(list)
    for i, v, _ in rows:
        own = [n * (math.floor(64 * float(c)) + 1_000_000) - s for c, s in zip(v, sums, strict=True)]
        scaled = (np.array(own) / n) @ vectors / np.sqrt(values)
        out[i].append((n, sum(c * c for c in own), scaled, values / np.trace(table)))
    return out


def test_whitened_rows_equal_the_plain_ones(spark):
    rows, odd = rows_of()
    frame = spark.createDataFrame([*rows, *odd], COLUMNS).repartition(5)
    frame = frame.selectExpr("*", "'a' as x", "'b' as component", "'c' as n", "'d' as size")
    got = whitening.whiten(frame).toPandas()
    want = plain_whitening(rows)
    assert len(got) == 16 * len(rows) and got.identity_error.nunique() == 1
    assert got.identity_error[0] < 1e-10
    signs = {}
    for vec_id, own in got.groupby("vec_id", dropna=False):
        vec_id = None if vec_id != vec_id else vec_id
        assert len(own) == 16 * len(want[vec_id])
        n, deviation, scaled, explained = want[vec_id][0]
        assert set(own.n) == {n} and set(own.deviation) == {deviation}
        for r in own.itertuples():
            target = scaled[r.component - 1]
            if abs(target) > 1e-3:
                sign = signs.setdefault(r.component, 1 if r.whitened * target > 0 else -1)
                assert r.whitened == pytest.approx(sign * target, rel=1e-7)
            assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-10)
    assert len(signs) == 16


def test_few_vectors_give_few_components(spark):
    rows = [(1, [0.0, 1.0, 2.0], "x"), (2, [3.0, 1.0, 2.0], "x"), (3, [3.0, 1.0, 2.0], "x")]
    got = whitening.whiten(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted((r.vec_id, r.component, r.n, abs(round(r.whitened, 12)), r.explained) for r in got) == [
        (1, 1, 2, 1.0, 1.0), (2, 1, 2, 1.0, 1.0), (3, 1, 2, 1.0, 1.0)
    ]
    assert whitening.whiten(spark.createDataFrame(rows[1:], COLUMNS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], COLUMNS)).count() == 0


def test_lengths_in_a_tie_go_to_the_longer(spark):
    rows = [(1, [0.0, 1.0], "x"), (2, [0.0], "x"), (3, [5.0, 1.0], "x"), (4, [2.0], "x")]
    got = whitening.whiten(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted(r.vec_id for r in got) == [1, 3]


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(i) * 2.0**40, 2.0**50 - i], "x") for i in range(1, 6)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")
    got = {r.vec_id: r.deviation for r in whitening.whiten(frame).collect()}
    x = [[math.floor(64 * c) for c in v] for _, v, _ in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((5 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    assert [got[i + 1] for i in range(5)] == [d if d < 2**63 else None for d in want]


def test_given_table(spark):
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/embeddings.parquet"
    if not Path(path).exists():
        pytest.skip("test tables are not here")
    got = whitening.whiten(spark.read.parquet(path)).toPandas()
    table = pq.read_table(path).to_pydict()
    rows = [(i, v, None) for i, v in zip(table["vec_id"], table["embedding"], strict=True)
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    want = plain_whitening(rows)
    assert len(got) == 16 * len(rows) and got.identity_error[0] < 1e-9
    for r in got[got.component == 1].itertuples():
        assert (r.n, r.deviation) == want[r.vec_id][0][:2]
    for k in range(1, 17):
        own = got[got.component == k]
        pairs = np.array([[r.whitened, want[r.vec_id][0][2][k - 1]] for r in own.itertuples()])
        assert min(np.abs(pairs[:, 0] - pairs[:, 1]).max(), np.abs(pairs[:, 0] + pairs[:, 1]).max()) < 1e-8
