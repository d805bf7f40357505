"""DuckDB SQL for the queries that SQL can express, written without the operators' code."""

from __future__ import annotations

import string

from opatlas.llm import quality_rules as rules

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

NGRAM_JOIN = f"""WITH RECURSIVE of_words AS (
  SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE
      WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram
  FROM of_words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM met o JOIN sizes x ON o.a = x.doc_id JOIN sizes y ON o.b = y.doc_id
  WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, CASE WHEN l.a = r.other THEN l.b ELSE l.a END
  FROM reached r JOIN links l ON r.other IN (l.a, l.b))
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id
FROM documents d JOIN reached r ON d.doc_id = r.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id"""

_RATIOS = {
    "symbols": "n_symbols / word_chars",
    "duplicate_lines": "n_dup_lines / n_lines",
    "repeated_words": "n_repeat_words / n_words",
    "word_length": "word_chars / n_words",
    "capitals": "n_capitals / word_chars",
}
_GRID = "\nUNION ALL\n".join(
    f"SELECT lang, good, '{rule}' AS rule, coalesce({_RATIOS[rule]}, 0.0) AS ratio, unnest({cutoffs}::DOUBLE[]) AS cutoff FROM labelled"
    for rule, cutoffs in rules.CUTOFFS.items()
)
_LIMIT = rules.FALSE_REJECTION
# P(Binomial(n, limit) <= k); the terms grow up to n * limit, so the last ones are the sum.
_TAIL = (
    "list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)"
    f" + i * ln({_LIMIT}) + (n - i) * ln(1 - {_LIMIT}))))"
)
_FAILED = ", ".join(
    f"CASE WHEN coalesce({ratio}, 0.0) > (SELECT cutoff FROM chosen c WHERE c.rule = '{rule}' AND c.lang IS NOT DISTINCT FROM m.lang)"
    f" THEN '{rule}' END"
    for rule, ratio in _RATIOS.items()
)
QUALITY_RULES = f"""WITH texts AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
places AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS pos, w FROM texts WHERE len(w) >= 3),
windows AS (SELECT doc_id, pos, [w[pos], w[pos + 1], w[pos + 2]] AS three FROM places),
again AS (SELECT doc_id, pos FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, three) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT pos + o.x) AS n FROM again, (SELECT unnest([0, 1, 2]) AS x) o GROUP BY doc_id),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS x FROM texts),
measured AS (
  SELECT t.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_capitals,
         len(x) AS n_lines, len(x) - len(list_distinct(x)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM texts t JOIN lines l ON t.doc_id = l.doc_id LEFT JOIN covered c ON t.doc_id = c.doc_id),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
marks AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
labelled AS (SELECT j.*, good FROM judged j JOIN marks ON j.doc_id = marks.doc_id WHERE NOT base_failed),
grid AS ({_GRID}),
counted AS (
  SELECT lang, rule, cutoff, count(*) FILTER (good = 1) AS n, count(*) FILTER (good = 1 AND ratio > cutoff) AS k,
         count(*) FILTER (good = 0 AND ratio > cutoff) AS bad
  FROM grid GROUP BY ALL),
tested AS (
  SELECT *, bool_and(k < n * {_LIMIT} AND {_TAIL} <= {rules.RISK} / (SELECT count(*) FROM (SELECT DISTINCT lang, rule FROM counted)))
              OVER (PARTITION BY lang, rule ORDER BY cutoff DESC) AS fits
  FROM counted),
usable AS (SELECT * FROM tested WHERE fits AND bad > k),
chosen AS (
  SELECT lang, rule, cutoff FROM usable
  QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY bad - k DESC, cutoff DESC) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND len(failed) = 0 AS kept, array_to_string(failed, ',') AS failed
FROM (SELECT *, list_filter([{_FAILED}], lambda f: f IS NOT NULL) AS failed FROM judged m)"""

ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard_join": NGRAM_JOIN,
    "op6_quality_rules": QUALITY_RULES,
}
