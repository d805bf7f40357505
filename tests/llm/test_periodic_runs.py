from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import cases
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("opatlas.llm")
from opatlas.llm import periodic_runs  # noqa: E402


def plain_runs(words):
    """Every stretch of equal lag that no neighbour extends, if no shorter lag explains it."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            own = words[i : i + length]
            smallest = next(p for p in range(1, q + 1) if own[p:] == own[:-p])
            if length >= max(24, 3 * q) and smallest == q:
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = cases.words(text)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(kept))


def repetitive(rng):
    words = []
    while len(words) < 400:
        kind = rng.random()
        if kind < 0.4:
            unit = [rng.choice("abcd") for _ in range(rng.randint(1, 30))]
            words += (unit * 9)[: len(unit) * 2 + rng.randint(0, len(unit) * 6)]
        elif kind < 0.5:
            inner = ["x"] * rng.randint(8, 30)
            words += (inner + ["y"]) * rng.randint(1, 4)
        else:
            words += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
    return words[: rng.randint(0, 400)]


@pytest.mark.parametrize("seed", range(40))
def test_runs_are_all_runs(seed):
    rng = random.Random(seed)
    texts = [[w.encode() for w in repetitive(rng)] for _ in range(6)]
    assert periodic_runs.runs_of(texts) == [plain_runs(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=120))
def test_runs_over_two_words(words):
    assert periodic_runs.runs_of([words]) == [plain_runs(words)]


@pytest.mark.parametrize("q", [1, 7, 8, 9, 15, 16, 17, 31, 32, 33])
def test_shortest_runs(q):
    unit = [b"w%d" % i for i in range(q)]
    least = max(24, 3 * q)
    whole = (unit * 24)[:least]
    assert periodic_runs.runs_of([[b"<", *whole, b">"]]) == [[(1, least, q)]]
    assert periodic_runs.runs_of([[b"<", *whole[:-1], b">"]]) == [[]]


def test_splitting_recurses():
    # the filler goes first, which leaves too few of each word around it
    words = np.array([1, 2, 3] * 4 + [9] + [1, 2, 3] * 9 + [4, 4, 8] + [1, 4] * 11)
    segments = periodic_runs.surviving(words, np.array([0, len(words)]))
    assert segments == [(13, 40)]


def test_a_long_text_with_few_words_stays_cheap():
    rng = random.Random(2)
    words = [rng.choice([b"a", b"b", b"c"]) for _ in range(300_000)]
    words[1000:] = words[1000:61_000] * 4 + words[241_000:]
    assert (1000, 240_000, 60_000) in [(s, n // 1000 * 1000, q) for s, n, q in periodic_runs.runs_of([words])[0]]


def test_query_equals_the_plain_version(spark):
    rng = random.Random(7)
    rows = [r for r in cases.documents() if r[1] is None or len(r[1]) < 5000]
    rows += [(1000 + i, " ".join(repetitive(rng)), "en", "s", 0) for i in range(60)]
    rows += [(2000 + i, cases.prose(rng, 90), "en", "s", 0) for i in range(60)]
    rows += [(5000, "la " * 5000, "en", "s", 0), (5001, " \n", "en", "s", 0)]
    got = periodic_runs.detected(cases.frame(spark, rows, clashing=True), fixture=True).collect()
    want = [plain_digest(r[0], r[1]) for r in rows]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r.n_runs > 0 for r in got) > 40


def test_spans_and_empty_table(spark):
    docs = cases.frame(spark, [(1, "x " + "a b c " * 10, None, None, None), (2, None, None, None, None)])
    assert [tuple(r) for r in periodic_runs.run_spans(docs).collect()] == [(1, 1, 30, 3)]
    empty = cases.frame(spark, [])
    assert periodic_runs.detected(empty).count() == 0 and periodic_runs.run_spans(empty).count() == 0
