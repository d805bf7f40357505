"""Small Column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of one group, as an array."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of one group, null when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def contains_any(text: Column, marks: list[str]) -> Column:
    hit = text.contains(marks[0])
    for mark in marks[1:]:
        hit = hit | text.contains(mark)
    return hit


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def in_order(first_seen: Column, capture_id: Column) -> Column:
    """Arrival order (time, then capture id) as one fixed-width number.

    A decimal can live in a hash aggregate's buffer, a struct cannot, so ``min`` over this
    column keeps the pre-aggregation a hash aggregate.  19 digits are left for the id.
    """
    shift = F.lit(str(10**19)).cast("decimal(20,0)")
    micros = F.unix_micros(first_seen.cast("timestamp")).cast("decimal(18,0)")
    return ((micros * shift).cast("decimal(38,0)") + capture_id.cast("decimal(19,0)")).cast(
        "decimal(38,0)"
    )


def without_first(array: Column) -> Column:
    return F.slice(array, F.lit(2), F.size(array))


def without_last(array: Column) -> Column:
    return F.slice(array, F.lit(1), F.greatest(F.size(array) - 1, F.lit(0)))
