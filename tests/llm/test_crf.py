"""The two conditional random fields: accuracy on held-out rows, odd texts, stages."""

from __future__ import annotations

import random

import cases
import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("opatlas.llm")
from opatlas.llm import language_crf, quality_crf  # noqa: E402
from opatlas.llm.crf import Batch, Field, fit  # noqa: E402
from opatlas.llm.word_arrays import parts  # noqa: E402

SF_DIR = "/root/testdata/sf0.01"


def test_gradient_ascent_learns_moves():
    rng = np.random.default_rng(0)
    first = np.arange(0, 2001, 20)
    labels = np.concatenate([np.cumsum(rng.random(20) < 0.1) % 2 for _ in range(100)])
    features = np.eye(2)[np.where(rng.random(2000) < 0.8, labels, 1 - labels)]
    field = fit([Batch(first, labels, np.ones(100), lambda w: features @ w, lambda v: features.T @ v)], 2, 2, 100, 0.1, 1e-4)
    alone = (features.argmax(axis=1) == labels).mean()
    found = (field.marginals(first, features @ field.weights).argmax(axis=1) == labels).mean()
    assert field.moves[0, 0] > field.moves[0, 1] and found > alone + 0.05


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    found = quality_crf.quality_digest(docs, labels)
    got = found.join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 50
    assert (got.predicted == got.quality).mean() >= 0.95
    assert (got[got.quality == 1].predicted == 1).mean() >= 0.98
    assert found.where("(score >= 0.3) <> (predicted = 1) or score < 0 or score > 1").count() == 0
    for doc_id, held_out in found.select("doc_id", "held_out").limit(50).collect():
        assert held_out == (cases.remainder(doc_id, 5) == 0)


def test_quality_of_odd_rows(spark):
    rows = cases.documents()
    docs = cases.frame(spark, rows, clashing=True)
    labels = cases.labels(spark, rows)
    scored = quality_crf.quality_digest(docs, labels).toPandas()
    assert len(scored) == len(rows)
    empty = {i for i, t, *_ in rows if i is not None and not cases.words(t)}
    assert (scored[scored.doc_id.isin(empty)].score == 0).all()
    kept = quality_crf.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert not {r.doc_id for r in kept.collect()} & empty
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    unlearned = quality_crf.quality_digest(docs, none).toPandas()
    assert set(unlearned.score) == {0.0, 0.5}
    assert quality_crf.quality_digest(cases.frame(spark, []), labels).count() == 0


def test_equal_texts_score_alike(spark):
    rng = random.Random(3)
    rows = [(i, cases.prose(rng, 80), "en", "s", 1) for i in range(20)] + [(99, "x\ny", "en", "s", 1)] * 3
    scored = quality_crf.quality_digest(cases.frame(spark, rows), cases.labels(spark, rows)).toPandas()
    assert scored[scored.doc_id == 99].score.nunique() == 1


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = language_crf.language_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() >= 0.98
    assert all(h == (cases.remainder(i, 4) == 2) for i, h in zip(got.doc_id, got.held_out, strict=True))
    assert got.score.between(0, 1).all()


def test_words_of_mixed_text(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    langs, field = language_crf.fit_languages(docs)
    texts = {lang: docs.where(f"lang = '{lang}' and doc_id % 7 = 3").limit(1).first().text.split()[:40] for lang in ("en", "fr")}
    import pyarrow as pa
    from opatlas.llm.word_arrays import parts

    ((_, _, part),) = parts(pa.array([" ".join(texts["en"] + texts["fr"])]))
    _, _, marginals = language_crf.word_marginals(field, part)
    found = marginals.argmax(axis=1)
    n = len(texts["en"])
    assert (found[:n] == langs.index("en")).mean() > 0.85
    assert (found[n:] == langs.index("fr")).mean() > 0.85


def test_languages_of_odd_rows(spark):
    rows = cases.documents()
    docs = cases.frame(spark, rows, clashing=True)
    got = language_crf.language_digest(docs).toPandas()
    assert len(got) == len(rows)
    lettered = {i: any(c.isalpha() for c in t or "") for i, t, *_ in rows if i is not None}
    for r in got.dropna(subset=["doc_id"]).itertuples():
        assert (r.lang_pred == "und") == (not lettered[r.doc_id])
    kept = language_crf.keep_one_language(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} <= {i for i, x in lettered.items() if x}
    assert language_crf.language_digest(cases.frame(spark, [])).count() == 0


@pytest.mark.parametrize("module, most", [(quality_crf, 100e6), (language_crf, 130e6)])
def test_scoring_a_large_batch_takes_little_memory(module, most):
    """Executors have two workers beside a full heap; a batch of 12 MB must not take ten times its size."""
    import tracemalloc

    rng = np.random.default_rng(3)
    words = np.array(["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(1, 9, 5000)])
    texts = [" ".join(words[rng.integers(0, 5000, 400)]) + "\n" for _ in range(6000)]
    column = pa.array(texts, pa.string())
    n_labels, n_features = (2, quality_crf.FEATURES) if module is quality_crf else (4, 1 << language_crf.TABLE_BITS)
    field = Field(rng.normal(size=(n_features, n_labels)), np.zeros(n_labels), np.zeros((n_labels, n_labels)))
    tracemalloc.start()
    for _, _, part in parts(column):
        if module is quality_crf:
            quality_crf._scores(field, part)
        else:
            language_crf._judged(["a", "b", "c", "d"], field, part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < most, peak
