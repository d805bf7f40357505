"""Personal data: patterns propose spans, checksums confirm them, context words score them.

DataFrame expressions only.  Every whole text is read; a null text counts as empty and has no
spans.  Equal rows are found equally often, extra columns don't matter, an empty table gives an
empty result.  Two spans of one kind never overlap; spans of different kinds may.

Kinds of the base: ``email``, ``ip`` (parts at most 255), ``card`` (14 to 19 digits passing
Luhn), ``phone`` (10 to 15 digits).  The method adds ``iban`` (confirmed by its remainder
modulo 97) and ``secret`` (a quoted run of hexadecimal digits that a context word introduces).

Patterns are possessive and start only where a run starts, so each is linear in the text: a
failing run is never tried again from its second character.  An account number may be followed by
words that could belong to it, so each of its starts is tried and the longest run of whole words that
its checksum confirms is the span.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opatlas.functions import brackets as B
from opatlas.functions.columns import all_matches, let
from opatlas.llm.tables import text_of

CONTEXT_CHARS = 40
BLOCK = 64

SPAN = "struct<start:bigint,rank:int,kind:string,stop:bigint,score:double>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of the text pass the Luhn check."""
    reverse = F.reverse(_digits(text))

    def weighed(i: Column) -> Column:
        digit = F.substring(reverse, i, F.lit(1)).cast("int")
        double = digit * 2
        return F.when(i % 2 == 1, digit).otherwise(F.when(double > 9, double - 9).otherwise(double))

    places = F.sequence(F.lit(1), F.length(reverse))
    total = F.aggregate(places, F.lit(0), lambda acc, i: acc + weighed(i))
    return (F.length(reverse) > 0) & (total % 10 == 0)


def mod97(text: Column) -> Column:
    """Whether an account number leaves 1 modulo 97, its first four characters moved to the end."""
    plain = F.regexp_replace(text, r"\x20", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def joined(acc: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code < 65, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), joined) == 1


def _ip_parts(text: Column) -> Column:
    return F.forall(
        F.split(text, r"\."),
        lambda part: F.length(F.regexp_replace(part, "^0+", "")).between(0, 3)
        & (F.regexp_replace(part, "^0+(?=.)", "").cast("int") <= 255),
    )


def _count_between(text: Column, low: int, high: int) -> Column:
    return F.length(_digits(text)).between(low, high)


@dataclass(frozen=True)
class Kind:
    """gate: cheap test that every text with a match passes; confirm: what a match must pass;
    weight: score of a confirmed match without context; least: score that it needs; whole: for a
    pattern that matches only a span's first characters and holds all that could belong to it in
    its group 1, what a run of that group's first words must look like."""

    name: str
    pattern: str
    gate: Callable[[Column], Column]
    confirm: Callable[[Column], Column]
    words: str
    weight: float
    least: float = 0.0
    whole: str | None = None


# The kinds, their patterns, and the context words that raise a score.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: t.contains("@"),
        lambda m: F.lit(True),
        r"mail|contact|write|address|kontakt|correo|courriel",
        0.7,
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        lambda t: t.rlike(r"[0-9]\.[0-9]"),
        _ip_parts,
        r"\bip\b|host|server|login|address",
        0.6,
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
        lambda m: _count_between(m, 14, 19) & luhn(m),
        r"card|visa|credit|karte|tarjeta|carte",
        0.7,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda t: t.contains("+"),
        lambda m: _count_between(m, 10, 15),
        r"phone|call|tel|fax|mobil",
        0.6,
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))[A-Z]{2}[0-9]{2}",
        lambda t: t.rlike("[A-Z]{2}[0-9]{2}"),
        mod97,
        r"iban|account|bank|konto|cuenta|compte",
        0.7,
        0.5,
        r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+$",
    ),
    Kind(
        "secret",
        r'(?<=")[0-9A-Fa-f]{32,}+(?=")',
        lambda t: t.contains('"'),
        lambda m: F.lit(True),
        r"token|secret|password|passwd|api.?key|credential",
        0.3,
        0.5,
    ),
)
BASE_KINDS = ("email", "ip", "card", "phone")


def _prefix_sums(values: Column) -> Column:
    """Sum of the values before each place, by blocks, so that long arrays stay cheap."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    def with_values(values: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
        empty = F.struct(
            F.array().cast("array<bigint>").alias("before"), F.lit(0).cast("bigint").alias("sum")
        )

        def add(acc: Column, block: Column) -> Column:
            own = total(F.slice(values, block * BLOCK + 1, F.lit(BLOCK)))
            return F.struct(
                F.concat(acc["before"], F.array(acc["sum"])).alias("before"),
                (acc["sum"] + own).alias("sum"),
            )

        def placed(starts: Column) -> Column:
            def before(x: Column, i: Column) -> Column:
                block = F.floor(i / BLOCK).cast("int")
                own = total(F.slice(values, block * BLOCK + 1, i % BLOCK))
                return F.element_at(starts, block + 1) + own

            return F.transform(values, before)

        return let(F.aggregate(blocks, empty, add)["before"], placed)

    return let(values, with_values)


def _longest_run(candidate: Column, kind: Kind) -> Column:
    """The longest run of the candidate's first words that is confirmed, null without one."""

    def of_words(words: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " ")
        )
        sure = F.filter(runs, lambda run: F.when(run.rlike(kind.whole), kind.confirm(run)).otherwise(False))
        return F.try_element_at(sure, F.lit(-1))

    return let(F.split(candidate, r"\x20", -1), of_words)


def _apart(found: Column) -> Column:
    """Spans by start, without those that begin before an earlier one of them ends."""

    def first_ones(spans: Column) -> Column:
        start = F.struct(F.array().cast(f"array<{SPAN}>").alias("kept"), F.lit(0).cast("bigint").alias("stop"))

        def add(acc: Column, span: Column) -> Column:
            after = span["start"] >= acc["stop"]
            return F.struct(
                F.when(after, F.concat(acc["kept"], F.array(span))).otherwise(acc["kept"]).alias("kept"),
                F.when(after, span["stop"]).otherwise(acc["stop"]).alias("stop"),
            )

        # the aggregate copies what it holds at every step, so only where spans do overlap
        overlap = F.exists(
            F.sequence(F.lit(2), F.size(spans)),
            lambda i: F.element_at(spans, i)["start"] < F.element_at(spans, i - 1)["stop"],
        )
        many = F.when(F.size(spans) > 1, overlap).otherwise(False)
        return F.when(many, F.aggregate(spans, start, add)["kept"]).otherwise(spans)

    return let(found, first_ones)


def _spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """Confirmed spans of one kind; ends exclusive, in code points."""

    def located(found: Column) -> Column:
        def among(between: Column) -> Column:
            gaps = F.transform(
                found, lambda m, i: (F.length(F.element_at(between, i + 1)) + F.length(m)).cast("bigint")
            )

            def scored(m: Column, i: Column, before: Column, own: Column) -> Column:
                left, right = F.element_at(between, i + 1), F.element_at(between, i + 2)
                start = before + F.length(left)
                if kind.whole:  # the rest of the span stands in what follows its match
                    right = F.substring(right, F.length(own) - F.length(m) + 1, F.length(right))
                near = F.lower(
                    F.concat_ws(" ", F.right(left, F.lit(CONTEXT_CHARS)), F.left(right, F.lit(CONTEXT_CHARS)))
                )
                score = F.lit(kind.weight) + F.when(near.rlike(kind.words), 0.3).otherwise(0.0)
                span = F.struct(
                    start.alias("start"),
                    F.lit(rank).alias("rank"),
                    F.lit(kind.name).alias("kind"),
                    (start + F.length(own)).alias("stop"),
                    score.alias("score"),
                )
                return F.when(own.isNotNull() if kind.whole else kind.confirm(m), span)

            def spans(starts: Column) -> Column:
                if not kind.whole:
                    proposed = F.transform(found, lambda m, i: scored(m, i, F.element_at(starts, i + 1), m))
                    return F.filter(proposed, lambda s: s.isNotNull() & (s["score"] >= kind.least))

                def with_runs(runs: Column) -> Column:
                    proposed = F.transform(
                        found,
                        lambda m, i: scored(m, i, F.element_at(starts, i + 1), F.element_at(runs, i + 1)),
                    )
                    return _apart(F.filter(proposed, lambda s: s.isNotNull() & (s["score"] >= kind.least)))

                candidates = all_matches(text, kind.pattern, 1)
                return let(F.transform(candidates, lambda c: _longest_run(c, kind)), with_runs)

            return let(_prefix_sums(gaps), spans)

        return F.when(F.size(found) > 0, let(F.split(text, kind.pattern, -1), among)).otherwise(
            F.array().cast(f"array<{SPAN}>")
        )

    return F.when(kind.gate(text), let(all_matches(text, kind.pattern), located)).otherwise(
        F.array().cast(f"array<{SPAN}>")
    )


def spans(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """All confirmed spans of a text, by start, then kind: array of (start, rank, kind, stop, score)."""
    return F.sort_array(F.concat(*[_spans_of(text, kind, rank) for rank, kind in enumerate(kinds)]))


def spans_text(found: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(
        F.transform(
            found,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """The table with one more column, ``out``: the spans of its text (empty for a null text)."""
    return docs.withColumn(out, spans(text_of(text)))


# Texts with more spans than this are cut by their characters, all at once.
FEW_SPANS = 32


def masked(text: Column, found: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets.

    Every span costs a walk to its place, so many spans are cut out of the array of the text's
    characters instead, which takes time in proportion to the text.
    """
    few = _replaced(text, found, lambda start, size: F.substring(text, (start + 1).cast("int"), size.cast("int")))
    many = let(
        F.split(text, ""),
        lambda characters: _replaced(
            text, found, lambda start, size: F.array_join(F.slice(characters, (start + 1).cast("int"), size.cast("int")), "")
        ),
    )
    return F.when(F.size(found) == 0, text).when(F.size(found) <= FEW_SPANS, few).otherwise(many)


def _replaced(text: Column, found: Column, cut: Callable[[Column, Column], Column]) -> Column:
    def pieces(upto: Column) -> Column:
        def one(span: Column, i: Column) -> Column:
            begin = F.coalesce(F.get(upto, i - 1), F.lit(0))
            kept = F.concat(cut(begin, span["start"] - begin), F.lit("<"), F.upper(span["kind"]), F.lit(">"))
            return F.when(span["start"] >= begin, kept).otherwise("")

        last = F.element_at(upto, -1)
        return F.concat(F.array_join(F.transform(found, one), ""), cut(last, F.length(text) - last))

    # how far the spans up to each reach
    return let(B.running(F.transform(found, lambda s: s["stop"]), lambda a, b: F.greatest(a, b)), pieces)


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """The table with personal data in its texts replaced; null texts stay null.

    A text without spans stays as it is.  Columns and their order don't change.
    """
    clean = let(F.col(text), lambda t: let(spans(t), lambda found: masked(t, found)))
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), clean))


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, all spans."""
    found = find_pii(docs.select("doc_id", "text")).drop("text")

    def base(kind: str) -> Column:
        own = F.filter("pii_spans", lambda s: s["kind"] == kind)
        return F.size(own).cast("bigint").alias(f"n_{kind}")

    of_base = F.filter("pii_spans", lambda s: s["rank"] < len(BASE_KINDS))
    return found.select(
        "doc_id",
        *[base(kind) for kind in BASE_KINDS],
        F.sha2(spans_text(of_base).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("pii_spans")).alias("spans"),
        F.transform("pii_spans", lambda s: s["score"]).alias("scores"),
    )
