from __future__ import annotations

import math
from collections import Counter

import cases
import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("opatlas.llm")
from opatlas.llm import hidden_markov as hmm  # noqa: E402
from opatlas.llm.word_arrays import parts  # noqa: E402


def base(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        if cases.remainder(doc_id, 7) != 2:
            counts.update([*cases.words(cases.lower(text)), None])
    total, kinds = sum(counts.values()), len(counts)

    def of(text):
        own = [*cases.words(cases.lower(text)), None]
        return len(own), sum(counts[w] > 0 for w in own), sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own)

    return total, of


@pytest.mark.parametrize("shared", [1 << 17, 40])
def test_base_scores_equal_a_plain_version(spark, monkeypatch, shared):
    """With few shared words most counts come through the join."""
    monkeypatch.setattr(hmm, "SHARED_WORDS", shared)
    monkeypatch.setattr(hmm, "SAMPLE_ROWS", 20)
    rows = [r for r in cases.documents() if r[0] != 7]
    total, of = base(rows)
    got = hmm.score_texts(cases.frame(spark, rows, clashing=True)).collect()
    assert len(got) == len(rows)
    texts = {}
    for doc_id, text, *_ in rows:
        texts.setdefault(doc_id, []).append(of(text))
    for r in got:
        assert r.train_tokens == total and r.held_out == (cases.remainder(r.doc_id, 7) == 2)
        assert any((r.n_tokens, r.n_known) == w[:2] and r.base_score == pytest.approx(w[2], rel=1e-9) for w in texts[r.doc_id])
        assert math.isfinite(r.score) and r.score < 0


def test_score_is_the_forward_sum(spark):
    """The model's probability of a text, by the plain recursion over groups and words."""
    rows = [r for r in cases.documents() if r[0] is not None and r[0] != 7]
    training = cases.frame(spark, [r for r in rows if cases.remainder(r[0], 7) != 2])
    counts = hmm.count_words(training)
    lexicon = hmm.read_lexicon(counts, training.count())
    model = hmm.trained(training, lexicon, hmm.first_model(training, lexicon, 3), passes=1)
    assert np.allclose(model.emits.sum(axis=1), 1) and np.allclose(model.moves.sum(axis=1), 1)
    by_word = {r.word: r.times for r in counts.collect()}
    scored = {r.doc_id: r for r in hmm._scored(training, lexicon, model).collect()}
    for doc_id, text, *_ in rows[:12]:
        if doc_id not in scored:
            continue
        ((_, _, part),) = parts(pa.array([text], pa.string())) if text else ((0, 1, None),)
        if part is None:
            continue
        tokens = hmm.tokens_of(part, lexicon)
        alpha, log = model.start, 0.0
        for t, group in enumerate(tokens.groups):
            alpha = (alpha if t == 0 else alpha @ model.moves) * model.emits[:, group]
            log += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        for place, group in zip(tokens.inverse, tokens.groups, strict=False):
            times = by_word.get(int(tokens.hashes[place].view(np.int64)), 0)
            log += math.log10((times + 1) / (lexicon.tokens[group] + lexicon.kinds[group] + 1))
        row = scored[doc_id]
        rare = sum(
            n * math.log10(by_word.get(int(w), 0) + 1)
            for w, n in zip(np.frombuffer(row.others, np.int64), np.frombuffer(row.times, np.int32), strict=True)
        )
        assert row.path + row.logs + rare == pytest.approx(log, rel=1e-9)


def test_model_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = hmm.score_texts(docs).where("held_out").selectExpr("sum(score) as s", "sum(base_score) as b").first()
    assert sums.s > sums.b


def test_turns_go_on_until_held_out_text_settles(spark, monkeypatch):
    """Also for texts of a kind that the sample of the first tables doesn't hold."""
    assert hmm.STATES >= 8
    learned = []
    monkeypatch.setattr(hmm, "SAMPLE_ROWS", 5)
    monkeypatch.setattr(hmm, "_scored", lambda docs, lexicon, model, of=hmm._scored: learned.append((lexicon, model)) or of(docs, lexicon, model))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").cache()
    hmm.score_texts(docs)
    ((lexicon, model),) = learned
    training = docs.where(hmm._is_training())
    more = hmm.trained(training, lexicon, model, passes=1)
    held = docs.where(~hmm._is_training())
    logs = [hmm._scored(held, lexicon, m).selectExpr("sum(path) as s", "sum(n_tokens) as n").first() for m in (model, more)]
    assert (logs[1].s - logs[0].s) * math.log(10) / logs[0].n <= hmm.SETTLED


def test_held_out_texts_never_change_the_model(spark, monkeypatch):
    learned = []
    monkeypatch.setattr(hmm, "SAMPLE_ROWS", 5)
    monkeypatch.setattr(hmm, "_scored", lambda docs, lexicon, model, of=hmm._scored: learned.append((lexicon, model)) or of(docs, lexicon, model))
    rows = [r for r in cases.documents() if r[0] is not None and r[0] != 7]
    for text in ("", "quite other words " * 500):
        changed = [(i, text if cases.remainder(i, 7) == 2 else t, *rest) for i, t, *rest in rows]
        hmm.score_texts(cases.frame(spark, changed))
    (first, one), (second, other) = learned
    assert (first.words == second.words).all() and (first.counts == second.counts).all()
    for a, b in ((one.start, other.start), (one.moves, other.moves), (one.emits, other.emits)):
        assert np.allclose(a, b, rtol=1e-6)


def test_empty_and_unlearned(spark):
    assert hmm.score_texts(cases.frame(spark, [])).count() == 0
    held = [i for i in range(60) if cases.remainder(i, 7) == 2][:3]
    got = hmm.score_texts(cases.frame(spark, [(i, "a b", None, None, None) for i in held])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)] * 3
