from __future__ import annotations

import random

import cases
import numpy as np
import pytest

pytest.importorskip("opatlas.llm")
from opatlas.llm import ngram_join as join  # noqa: E402
from opatlas.llm.components import components  # noqa: E402


def check(spark, rows, **options):
    got = join.jaccard_components(cases.frame(spark, rows, clashing=True)).collect()
    want = cases.components([t for _, t, *_ in rows])
    members = {}
    for place, (_, root) in enumerate(want):
        members.setdefault(root, []).append(rows[place][0])
    expected = sorted(
        (str(rows[p][0]), n, str(min((i for i in members[root] if i is not None), default=None)))
        for p, (n, root) in enumerate(want)
    )
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == expected


def test_odd_rows_equal_brute_force(spark):
    rows = cases.documents()
    # one id with two texts would name two nodes; keep ids unique but for whole repeated rows
    rows = [r for r in rows if r[0] != 7 and not (r[0] is None and r[1] is None)]
    check(spark, rows)


def families(rng, base_words, copies, edits):
    out = []
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(base_words)]
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


def test_large_families_with_small_blocks(spark, monkeypatch):
    """Blocks, long columns and the frequent n-grams' place in the order, all at work."""
    for name, value in (("BLOCK", 16), ("SHORT_COLUMN", 3), ("SEEN_OFTEN", 2), ("SEEN_BUFFER", 2000)):
        monkeypatch.setattr(join, name, value)
    rng = random.Random(4)
    line = " ".join(f"common{i}" for i in range(12))
    texts = families(rng, 60, 90, 4) + families(rng, 25, 40, 3) + families(rng, 8, 12, 1)
    texts += [f"{line} " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(60)]
    texts += [line] * 3 + [f"{line} more"]
    rng.shuffle(texts)
    check(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])


def test_tiles_of_the_product(monkeypatch):
    monkeypatch.setattr(join, "TILE", 8)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**60, 60).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.06, rng.integers(0, 2**60, 60), base).astype(np.uint64)) for _ in range(70)]
    sets += [np.unique(rng.integers(0, 90, 12).astype(np.uint64)) for _ in range(30)]
    found = {(int(i), int(j)) for x, y in join.product_links(sets[:40], sets) for i, j in zip(x, y, strict=True)}
    want = set()
    for i in range(40):
        for j, other in enumerate(sets):
            both = len(np.intersect1d(sets[i], other))
            if 100 * both >= 80 * (len(sets[i]) + len(other) - both):
                want.add((i, j))
    assert found == want and len(want) > 100


def test_prefix_path_finds_what_families_miss(spark, monkeypatch):
    """With no families at all, the prefix filter and the whole check must find every link."""
    monkeypatch.setattr(join, "keys_of", lambda own: (own.sum(), own.sum() ^ own.max(), own.sum() + own.max()))
    rng = random.Random(6)
    texts = families(rng, 50, 30, 4) + families(rng, 30, 6, 2)
    check(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])


def test_sets_of_random_words_near_the_limit(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(150):
        own = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        texts.append(" ".join(own))
    check(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (7, 7)]
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [
        (5, "a b c d e f g", "en", "s", 1), (2, "A b c d e f g", "en", "s", 1), (2, "A b c d e f g", "en", "s", 1),
        (None, "a b c d e f g", "en", "s", 1), (None, "only here", "en", "s", 1), (9, "", "en", "s", 1), (10, None, "en", "s", 1),
    ]
    docs = cases.frame(spark, rows, clashing=True)
    kept = join.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(
        map(str, [(2, "A b c d e f g"), (None, "only here"), (9, ""), (10, None)])
    )


def test_empty_table(spark):
    assert join.jaccard_components(cases.frame(spark, [])).count() == 0
    assert join.keep_one_each(cases.frame(spark, [])).count() == 0


def test_one_id_on_several_texts(spark):
    a, b, c, d = (f"{x} one two three four five six seven {x}{x}" for x in ("aa", "bb", "cc", "dd"))
    a, b, c, d = (" ".join(w + t[:2] for w in t.split()) for t in (a, b, c, d))
    rows = [(7, a), (7, b), (5, c), (5, d), (3, d), (9, c), (5, d), (8, None), (8, ""), (8, a), (None, b), (None, "zz")]
    docs = cases.frame(spark, [(i, t, "en", "s", 1) for i, t in rows], clashing=True)
    kept = join.keep_one_each(docs)
    assert kept.columns == docs.columns
    left = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert left == [(0, "zz"), (3, d), (5, c), (7, a), (7, b), (8, "")]


def candidates_of(spark, monkeypatch, texts):
    counted = []
    whole = join._checked

    def checked(docs, candidates):
        counted.append(candidates.count())
        return whole(docs, candidates)

    monkeypatch.setattr(join, "_checked", checked)
    check(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    return counted[0]


def test_a_passage_in_all_texts_lists_no_pairs(spark, monkeypatch):
    """Texts that are mostly one passage, but too little of it to link: pairs don't grow with their square."""
    monkeypatch.setattr(join, "keys_of", lambda own: (own.sum(), own.sum() ^ own.max(), own.sum() + own.max()))
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(80))
    for n in (60, 240):
        own = [" ".join(f"u{rng.randint(0, 10**9)}" for _ in range(30)) for _ in range(n)]
        texts = [f"{passage} {o}" if i % 2 else f"{o} {passage}" for i, o in enumerate(own)]
        assert candidates_of(spark, monkeypatch, texts) <= n
        monkeypatch.undo()
        monkeypatch.setattr(join, "keys_of", lambda own: (own.sum(), own.sum() ^ own.max(), own.sum() + own.max()))
