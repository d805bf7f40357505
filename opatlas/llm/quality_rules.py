"""Quality rules whose cutoffs are chosen with a guarantee against rejecting good documents.

DataFrame expressions only.  Each rule compares one ratio of a document with a cutoff.  A cutoff
may be used in a stratum (a language) only if an exact binomial bound on labelled documents shows
that it rejects at most ``FALSE_REJECTION`` of the good ones: with ``n`` good documents of which
it rejects ``k``, P(Binomial(n, FALSE_REJECTION) <= k) must not exceed ``RISK`` divided by the
number of sequences of tests (strata x rules).  The cutoffs of one rule are tested in a fixed
sequence, the mildest first, up to the first that fails, which takes no further share of the risk; so
all choices hold together with probability 1 - ``RISK``.  Of the usable cutoffs of a rule the one that
rejects the most bad documents net of good ones is taken, the mildest at ties; without a usable one
the rule is off in that stratum.  With four languages a rule needs 197 good labelled documents that
pass the base rules in a language if it rejects none of them, 271 if it rejects one.

A null or empty text has no words, fails the base rules and isn't kept.  A null language is a
stratum of its own.  Repeated rows are judged alike; a document labelled twice counts by its
lowest quality label; null labels don't count.  Without labels only the base rules hold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opatlas.functions.columns import all_matches, let
from opatlas.llm.tables import WHITE, text_of, written

# Share of a stratum's good documents that one rule may reject, and the risk of breaking that.
FALSE_REJECTION = 0.03
RISK = 0.05
# Terms of a binomial tail that are summed one by one; the rest is bounded by its geometric sum.
TAIL_TERMS = 20_000

# The candidate cutoffs of each rule; a document whose ratio is above is rejected.
CUTOFFS = {
    "symbols": [0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3],
    "duplicate_lines": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8],
    "repeated_words": [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45],
    "word_length": [7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0],
    "capitals": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8],
}


def _repeated(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text."""

    def windows() -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(words) - 2),
            lambda i: F.struct(
                F.xxhash64(
                    F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)
                ).alias("window"),
                i.alias("at"),
            ),
        )

    def of_sorted(ordered: Column) -> Column:
        # element_at is 1-based: i + 1 is this entry, i the one before.
        def same(i: Column, j: Column) -> Column:
            return F.element_at(ordered, i)["window"] == F.element_at(ordered, j)["window"]

        last = F.size(ordered)
        again = F.filter(
            ordered,
            lambda w, i: F.when(i > 0, same(F.greatest(i, F.lit(1)), i + 1)).otherwise(False)
            | F.when(i + 1 < last, same(i + 1, F.least(i + 2, last))).otherwise(False),
        )
        return let(F.sort_array(F.transform(again, lambda w: w["at"])), covered)

    def covered(places: Column) -> Column:
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop")),
            lambda acc, at: F.struct(
                (acc["n"] + at + 3 - F.greatest(acc["stop"], at)).alias("n"), (at + 3).alias("stop")
            ),
            lambda acc: acc["n"],
        )

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.sort_array(windows()), of_sorted))


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Counts of each whole text, beside the columns named in ``keep``."""
    text = text_of()
    words = all_matches(text, f"[^{WHITE}]+")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{WHITE}]"))
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            _repeated(w).cast("bigint").alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("bigint").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        ),
    )
    return (
        docs.select(
            *keep,
            of_words.alias("of_words"),
            of_lines.alias("of_lines"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).cast("bigint").alias("n_capitals"),
        )
        .select(*keep, "of_words.*", "of_lines.*", "n_symbols", "n_capitals")
        .withColumn(
            "base_failed",
            (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50),
        )
    )


def ratios() -> dict[str, Column]:
    def share(top: str, bottom: str) -> Column:
        return F.coalesce(F.try_divide(F.col(top), F.col(bottom)), F.lit(0.0)).cast("double")

    return {
        "symbols": share("n_symbols", "word_chars"),
        "duplicate_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
        "capitals": share("n_capitals", "word_chars"),
    }


def _log_gamma(z: Column) -> Column:
    """ln Gamma(z) for z >= 1, by Stirling's series at z + 8."""
    y = z + 8
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    at_y = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + series
    down = F.lit(0.0)
    for i in range(8):
        down = down + F.ln(z + i)
    return at_y - down


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(Binomial(n, p) <= k) for k below n * p, 0 from there on."""
    k, n = k.cast("double"), n.cast("double")
    choices = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1)
    first = choices + k * F.ln(F.lit(p)) + (n - k) * F.ln(F.lit(1 - p))
    odds = (1 - p) / p
    steps = F.least(k, F.lit(TAIL_TERMS)).cast("int")

    def add(acc: Column, i: Column) -> Column:
        at = k - i + 1
        term = acc["term"] * at / (n - at + 1) * odds
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    places = F.when(steps > 0, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    summed = F.aggregate(places, start, add)
    at = k - steps
    ratio = at / (n - at + 1) * odds
    total = let(summed, lambda s: s["sum"] + s["term"] * ratio / (1 - ratio))
    return F.when(k < n * p, first + F.ln(total)).otherwise(0.0)


def choose_cutoffs(
    measured: DataFrame,
    stratum: str,
    quality: str,
    false_rejection: float = FALSE_REJECTION,
    risk: float = RISK,
) -> DataFrame:
    """(stratum, rule, cutoff): the cutoff of each rule that may be used, null where none may.

    ``measured``: the counts of ``measures`` with a stratum and a quality label (1 good, 0 bad).
    """
    by_rule = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                value.alias("ratio"),
            )
            for rule, value in ratios().items()
        ]
    )
    grid = F.create_map(
        *[
            part
            for rule, cutoffs in CUTOFFS.items()
            for part in (F.lit(rule), F.array(*[F.lit(float(c)) for c in cutoffs]))
        ]
    )
    counted = (
        measured.where(~F.col("base_failed"))
        .select(F.col(stratum).alias("stratum"), F.col(quality).alias("good"), F.inline(by_rule))
        .select(
            "stratum", "rule", "good",
            F.inline(
                F.transform(
                    F.element_at(grid, F.col("rule")),
                    lambda c: F.struct(c.alias("cutoff"), (F.col("ratio") > c).alias("rejected")),
                )
            ),
        )
        .groupBy("stratum", "rule", "cutoff")
        .agg(
            F.count_if(F.col("good") == 1).alias("n"),
            F.count_if((F.col("good") == 1) & F.col("rejected")).alias("k"),
            F.count_if((F.col("good") == 0) & F.col("rejected")).alias("bad"),
        )
    )
    counted = written(counted, "cutoff-counts")  # a row for each stratum, rule and cutoff
    sequences = max(1, counted.select("stratum", "rule").distinct().count())
    tail = log_binomial_tail(F.col("k"), F.col("n"), false_rejection)
    milder = Window.partitionBy("stratum", "rule").orderBy(F.desc("cutoff"))
    usable = F.min((tail <= math.log(risk / sequences)).cast("int")).over(milder) == 1
    best = F.max_by(
        F.col("cutoff"), F.struct(F.col("bad") - F.col("k"), F.col("cutoff"))
    )
    return (
        counted.withColumn("usable", usable)
        .where(F.col("usable") & (F.col("bad") > F.col("k")))
        .groupBy("stratum", "rule")
        .agg(best.alias("cutoff"))
    )


def label_quality(labels: DataFrame) -> DataFrame:
    """(doc_id, quality), one row a document; ids and labels that are null don't count."""
    return (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )


def apply_rules(measured: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """``measured`` with ``failed``, the rules whose cutoff a document exceeds, and ``kept``.

    The cutoffs go to every task: they are one row for each stratum, a few numbers wide; a
    stratum without usable cutoffs has none.
    """
    wide = cutoffs.groupBy(F.col("stratum").alias("of_stratum")).agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")
    )
    joined = measured.join(wide, F.col(stratum).eqNullSafe(F.col("of_stratum")), "left")
    failed = F.array(
        *[
            F.when(value > F.element_at(F.col("cutoffs"), F.lit(rule)), F.lit(rule))
            for rule, value in ratios().items()
        ]
    )
    return (
        joined.withColumn("failed", F.array_compact(failed))
        .drop("cutoffs", "of_stratum")
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    )


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Counts, ``base_failed``, ``failed`` and ``kept`` of every document."""
    counts = measures(docs.select("doc_id", "text", stratum), ["doc_id", stratum])
    measured = written(counts, "rule-measures")  # numbers only; each text is read once
    labelled = measured.join(label_quality(labels), "doc_id")
    return apply_rules(measured, choose_cutoffs(labelled, stratum, "quality"), stratum)
