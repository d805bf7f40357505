from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import cases
import pytest

pytest.importorskip("opatlas.llm")
from opatlas.llm import quality_rules as rules  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def measured(text):
    own, counts, covered = cases.words(text), Counter(), set()
    windows = list(zip(own, own[1:], own[2:], strict=False))
    counts.update(windows)
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if cases.words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return (len(own), sum(map(len, own)), symbols, len(lines) - len(set(lines)), len(covered))


def test_counts_equal_a_plain_version(spark):
    rows = cases.documents()
    docs = cases.frame(spark, rows, clashing=True)
    judged = rules.judge(docs, cases.labels(spark, rows)).collect()
    assert len(judged) == len(rows)
    texts = {}
    for i, text, *_ in rows:
        texts.setdefault(i, []).append(measured(text))
    for r in judged:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got in texts[r.doc_id]
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert not (r.kept and r.base_failed)


def test_tail_is_the_binomial_one(spark):
    cases_ = [(0, 2000), (3, 2000), (50, 20_000), (0, 100), (9, 2000), (10, 2000)]
    got = spark.createDataFrame(cases_, "k bigint, n bigint").select(
        "k", "n", rules.log_binomial_tail(F.col("k"), F.col("n"), 0.005).alias("tail")
    )
    for r in got.collect():
        terms = [
            math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.005) + (r.n - i) * math.log(0.995)
            for i in range(r.k + 1)
        ]
        want = math.log(math.fsum(map(math.exp, terms))) if r.k < r.n * 0.005 else 0.0
        assert r.tail == pytest.approx(want, abs=1e-6)


def labelled(spark, n_good, n_good_above, n_bad):
    rows = [("en", 1, 0.4 if i < n_good_above else 0.0) for i in range(n_good)] + [("en", 0, 0.4)] * n_bad
    return spark.createDataFrame(rows, "lang string, quality int, ratio double").selectExpr(
        "lang", "quality", "1000L as word_chars", "200L as n_words", "0L as n_repeat_words", "10L as n_lines",
        "0L as n_dup_lines", "cast(ratio * 1000 as bigint) as n_symbols", "0L as n_capitals", "false as base_failed",
    )


@pytest.mark.parametrize(
    ("n_good", "above", "chosen"),
    [(3000, 0, True), (100, 0, False), (152, 0, True), (151, 0, False), (3000, 15, True), (3000, 70, False), (3000, 90, False)],
)
def test_a_cutoff_needs_evidence(spark, n_good, above, chosen):
    found = rules.choose_cutoffs(labelled(spark, n_good, above, 100), "lang", "quality").collect()
    assert [(r.stratum, r.rule) for r in found] == ([("en", "symbols")] if chosen else [])
    if chosen:  # the mildest of those that reject all bad documents
        assert found[0].cutoff == 0.3


def plain_tail(k, n, p):
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_cutoffs_are_tested_in_sequence(spark):
    """Milder cutoffs first: the strictest one that passes is used where it rejects more bad ones."""
    good = [("en", 1, r) for r in [0.0] * 700 + [0.03] * 3 + [0.09] * 2] + [("xx", 1, 0.0)] * 150
    bad = [("en", 0, r) for r in [0.035] * 40 + [0.4] * 20] + [("xx", 0, 0.4)] * 50
    rows = spark.createDataFrame(good + bad, "lang string, quality int, ratio double").selectExpr(
        "lang", "quality", "1000L as word_chars", "200L as n_words", "0L as n_repeat_words", "10L as n_lines",
        "0L as n_dup_lines", "cast(ratio * 1000 as bigint) as n_symbols", "0L as n_capitals", "false as base_failed",
    )
    found = {(r.stratum, r.rule): r.cutoff for r in rules.choose_cutoffs(rows, "lang", "quality").collect()}
    risk = rules.RISK / (2 * len(rules.CUTOFFS))
    usable = []
    for cutoff in sorted(rules.CUTOFFS["symbols"], reverse=True):
        if plain_tail(sum(r > cutoff for lang, _, r in good if lang == "en"), 705, rules.FALSE_REJECTION) > risk:
            break
        usable.append(cutoff)
    want = max(usable, key=lambda c: (sum(r > c for _, _, r in bad[:60]) - sum(r > c for lang, _, r in good if lang == "en"), c))
    assert found == {("en", "symbols"): want} and want == 0.03  # 150 good ones prove nothing for ten sequences


def test_every_language_of_the_given_table_has_a_rule(spark):
    for sf, languages in (("sf0.1", {"en", "de", "fr", "es"}), ("sf0.01", {"en"})):
        folder = Path(f"/root/testdata/{sf}")
        if not folder.exists():
            pytest.skip("test tables are not here")
        docs, marks = (spark.read.parquet(str(folder / f"{t}.parquet")) for t in ("documents", "labels"))
        measured = rules.measures(docs, ["doc_id", "lang"]).join(rules.label_quality(marks), "doc_id")
        found = rules.choose_cutoffs(measured, "lang", "quality").collect()
        assert languages <= {r.stratum for r in found}


def test_empty_tables(spark):
    rows = cases.documents()[:5]
    none = cases.frame(spark, [])
    assert rules.judge(none, cases.labels(spark, rows)).count() == 0
    unlabelled = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    judged = rules.judge(cases.frame(spark, rows), unlabelled).collect()
    assert all(r.kept != r.base_failed for r in judged)
