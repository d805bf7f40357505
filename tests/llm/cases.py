"""Small tables for the operators' tests, and plain versions to hold their results against."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# extra columns whose names the operators use themselves
CLASHING = ["score", "node", "length", "piece", "row", "quality", "kept_id", "found_lang", "lang_score", "quality_score", "pii_spans"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group(0).lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, lang="en"):
    stems = {"en": ["the", "and", "tion", "ing", "er", "th", "wh"], "fr": ["le", "eau", "oi", "eux", "é", "qu"]}[lang]
    out = ["".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    lines = [" ".join(out[i : i + 12]) + "." for i in range(0, n, 12)]
    return "\n".join(lines)


def documents(seed=1):
    """Ordinary, odd, copied and nearly copied texts; nulls in every column; repeated rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(5, 200), rng.choice(["en", "fr"])) for _ in range(120)]
    texts += [prose(rng, 60, "en").replace(" ", "### ") for _ in range(30)]
    base = prose(rng, 150).split(" ")
    for _ in range(40):
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = f"x{rng.randint(0, 99)}"
        texts.append(" ".join(own))
    texts += [texts[0], texts[0].upper(), texts[1] + "\n", "", None, " \t\n\x0b", "one two three", "One  two three",
              "one two", "été 日本 😀", "12 34 ++", "→ —", "word " * 20_000, "x" * 60_000, "a\r\nb c d e f"]
    rows = []
    for i, text in enumerate(texts):
        lang = "fr" if text and "eau" in text else "en"
        rows.append((i * 3, text, lang, f"s{i % 3}", len(text or "")))
    rows += [rows[5], rows[5], (None, texts[7], None, None, None), (None, None, None, None, None), (7, texts[9], None, "s", 1)]
    return rows


def frame(spark, rows, clashing=False):
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    if clashing:
        docs = docs.selectExpr("*", *[f"concat('extra ', coalesce(source, '')) as {c}" for c in CLASHING])
    return docs


def labels(spark, rows):
    known = [(i, 0 if t and "###" in t else 1, 0) for i, t, *_ in rows if i is not None and t]
    known += [(None, 1, 0), (3, None, None), (6, 1, 1)]
    return spark.createDataFrame(known, "doc_id bigint, quality int, toxic int")


def remainder(doc_id, modulus):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def components(texts):
    """(size of the set, smallest place linked) of each text, by counting all shared n-grams."""
    sets = []
    for text in texts:
        own = words(lower(text))
        sets.append({tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set())
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for i, own in enumerate(sets):
        shared = Counter(j for gram in own for j in having[gram])
        for j, both in shared.items():
            if 100 * both >= 80 * (len(own) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for gram in own:
            having[gram].append(i)
    return [(len(own), root(i)) for i, own in enumerate(sets)]
