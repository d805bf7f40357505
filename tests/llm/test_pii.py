from __future__ import annotations

import hashlib
import random
import re
import time

import cases
import pytest

pytest.importorskip("opatlas.llm")
from opatlas.llm import pii  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(digits)) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            n = sum(c.isdigit() for c in m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= n <= 19 and luhn(m[0])):
                continue
            if kind == "phone" and not 10 <= n <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def texts():
    rng = random.Random(5)
    bits = ["a@b.c", "_d@e.f.", "@", ".", "1.2.3.4", "300.1.1.1", "4242 4242 4242 4242", "42424242-42424242-",
            "+1 (555) 222-3333", "+", "é", "😀", " ", "\n", "000.0.0.01", "a", "-", "x%", "1", "22", ".5", "+49 30 ((",
            "0378282246310005", '"']
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    return [*out, "", None, "1.2.3.4 " * 2000, "1" * 30_000, "a" * 30_000 + "@", "+1 " + " " * 30_000]


def test_base_spans_equal_a_plain_scan(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts())] + [(None, "a@b.c", None, None, None)]
    found = pii.pii_digest(cases.frame(spark, rows, clashing=True)).collect()
    assert len(found) == len(rows)
    for row in found:
        text = "a@b.c" if row.doc_id is None else rows[row.doc_id][1]
        want = base_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text
        counts = [sum(k == kind for _, _, k, _ in want) for kind in BASE]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts
        assert set(joined.split(",")) - {""} <= set(row.spans.split(","))


def test_added_kinds_need_checksum_or_context(spark):
    rows = [
        (0, "IBAN DE89370400440532013000 ok", None, None, None),
        (1, "IBAN DE89370400440532013001 ok", None, None, None),
        (2, 'token = "' + "ab" * 16 + '"', None, None, None),
        (3, 'colour "' + "ab" * 16 + '"', None, None, None),
    ]
    found = {r.doc_id: r.spans for r in pii.pii_digest(cases.frame(spark, rows)).collect()}
    assert found == {0: "iban:5:27", 1: "", 2: "secret:9:41", 3: ""}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("iban DE89370400440532013000 Please pay", "iban:5:27"),
        ("iban DE89370400440532013000 BIC COBADEFF", "iban:5:27"),
        ("iban DE89370400440532013000 I", "iban:5:27"),
        ("iban DE89370400440532013000 2024", "iban:5:27"),
        ("iban DE89 3704 0044 0532 0130 00 Please pay", "iban:5:32"),
        ("DE89370400440532013000 GB82WEST12345698765432 NO9386011117947 X", "iban:0:22,iban:23:45,iban:46:61"),
        ("AB12CD34EF56GH78 DE89370400440532013000", "iban:17:39"),
        ("DE89370400440532013000x", ""),
        ("DE89370400440532013001 Please pay", ""),
    ],
)
def test_account_numbers_before_other_words(spark, text, want):
    (row,) = pii.pii_digest(cases.frame(spark, [(0, text, None, None, None)])).collect()
    assert ",".join(s for s in row.spans.split(",") if s.startswith("iban")) == want


def test_context_raises_the_score(spark):
    rows = [(0, "my card 4242424242424242", None, None, None), (1, "4242424242424242", None, None, None)]
    scores = {r.doc_id: r.scores[0] for r in pii.pii_digest(cases.frame(spark, rows)).collect()}
    assert scores[0] > scores[1]


def test_masking_keeps_columns_and_other_text(spark):
    docs = cases.frame(spark, [(0, "é a@b.c, 1.2.3.4!", "en", "s", 1), (1, None, "en", "s", 1), (2, "plain", "en", "s", 1)], True)
    masked = pii.mask_pii(docs)
    assert masked.columns == docs.columns
    assert {r.doc_id: r.text for r in masked.collect()} == {0: "é <EMAIL>, <IP>!", 1: None, 2: "plain"}


def test_empty_table(spark):
    assert pii.pii_digest(cases.frame(spark, [])).count() == 0


def plain_mask(text, found):
    out, stop = "", 0
    for kind, start, end in found:
        if start >= stop:
            out += text[stop:start] + f"<{kind.upper()}>"
        stop = max(stop, end)
    return out + text[stop:]


def test_masks_equal_a_plain_version(spark):
    rng = random.Random(5)
    rows = []
    for n in (0, 1, 5, 31, 32, 33, 200):
        text = "".join(rng.choice("aé😀 \n") for _ in range(400))
        places = sorted((rng.randint(0, 390), rng.randint(1, 10)) for _ in range(n))
        rows.append((text, [("email" if a % 2 else "ip", a, min(400, a + size)) for a, size in places]))
    df = spark.createDataFrame(rows, "text string, found array<struct<kind:string,start:bigint,stop:bigint>>")
    got = [r.m for r in df.select(pii.masked(F.col("text"), F.col("found")).alias("m")).collect()]
    assert got == [plain_mask(text, found) for text, found in rows]


def test_masking_many_spans_takes_linear_time(spark):
    def seconds(n):
        text = " ".join(f"write to user{i}@example{i}.org now" for i in range(n))
        df = spark.createDataFrame([(text,)], "text string")
        start = time.perf_counter()
        ((masked,),) = pii.mask_pii(df).collect()
        assert masked.count("<EMAIL>") == n and "@" not in masked
        return time.perf_counter() - start

    seconds(50)
    assert seconds(32_000) < 14 * max(seconds(4_000), 0.5)
