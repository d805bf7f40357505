from __future__ import annotations

import random

import numpy as np
import pytest

pytest.importorskip("opatlas.llm")
from opatlas.llm import graph_search as graph  # noqa: E402

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, top=20):
    """(query, id) -> score of the true nearest, ties to smaller ids."""
    known = {}
    for i, v, _ in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v) or len(v) != 8:
            continue
        known[i] = np.array(v, np.float32).astype(float)
    ids = np.array(sorted(known))
    matrix = np.stack([known[i] for i in ids])
    out = {}
    for q in ids[ids % 20 == 0]:
        score = matrix @ known[q]
        order = np.lexsort((ids, -score))
        out[q] = [(int(ids[i]), float(score[i])) for i in order if ids[i] != q][:top]
    return out


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=8) * rng.uniform(0.5, 2)).tolist(), 0) for i in range(n)]


def result(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as score", "2 as rank", "3 as shard", "4 as block").repartition(3)
    found = graph.nearest(frame, **options).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        own = out.setdefault(r.query_id, [])
        assert r.rank == len(own) + 1
        own.append((r.vec_id, r.score))
    return out


def recall(got, want):
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    return hits / sum(map(len, want.values()))


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHARD_ROWS", 400)  # several shards
    rows = vectors(1500)
    got = result(spark, rows)
    known = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows}
    for q, own in got.items():
        assert all(s == pytest.approx(known[q] @ known[i], rel=1e-12) for i, s in own)
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))
    assert recall(got, plain(rows)) >= 0.95


def test_test_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = frame.toPandas()
    matrix = np.stack(table.embedding).astype(float)
    ids = table.vec_id.to_numpy()
    got = {}
    for r in graph.nearest(frame).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = matrix @ matrix[i]
        score[i] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -score))[:20]]) & got[ids[i]])
    assert hits / (20 * len(got)) >= 0.9


def test_odd_vectors_and_ties(spark):
    rng = random.Random(2)
    rows = vectors(120, 3)
    rows += [(200 + i, [1.0] + [0.0] * 7, 0) for i in range(61)]  # one vector, many ids
    rows += [(400, None, 0), (401, [0.0] * 8, 0), (402, [1.0] * 7 + [None], 0), (403, [float("nan")] + [1.0] * 7, 0),
             (404, [float("inf")] + [1.0] * 7, 0), (405, [], 0), (406, [1.0] * 3, 0), (None, [1.0] * 8, 0),
             (420, [-0.0, 1.0] + [0.0] * 6, 0), (421, [0.0, 1.0] + [0.0] * 6, 0)]
    rows += rows[:3]
    rng.shuffle(rows)
    got, want = result(spark, rows), plain(rows)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


@pytest.mark.parametrize("times", [1e4, 1e20, 1e-20])
def test_recall_beside_a_vector_of_another_length(spark, times):
    rows = vectors(1500, 4)
    rows[7] = (7, [x * times for x in rows[7][1]], 0)
    rows[40] = (40, [x * times for x in rows[40][1]], 0)
    assert recall(result(spark, rows), plain(rows)) >= 0.95


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    got = result(spark, vectors(n))
    assert {q: len(v) for q, v in got.items()} == ({0: n - 1} if n > 1 else {})


def test_pruning_keeps_diverse_edges():
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1], [-5, 0]], np.float32)
    kept = graph.robust_prune(points, np.array([0]), np.array([[1, 2, 3, 4, -1, 0]]), 4, 1.2)
    assert kept[0].tolist() == [1, 3, 4, -1]
