"""Exact brackets of any depth, as Column expressions in nearly linear time.

A text is cut into pieces, each of which opens a bracket (+1), closes one (-1) or neither (0).
Running sums give the depth after every piece; pieces in the order (depth, place) put each closing
bracket right behind the one it closes.  Sums take log2(n) passes over the array, the order one sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from opatlas import fixed_values as V
from opatlas.functions.columns import all_matches, let

# A string of a script or an operation; one that never closes takes the rest of the text.
STRING_TOKEN = r'"(?:[^"\\]++|\\[\s\S])*+(?:"|\\?\z)'
ROUND_PIECE = r"[^()]*+[()]|[^()]++"
BRACE_PIECE = r"[^{}]*+[{}]|[^{}]++"
# Strings are taken whole, so brackets inside of them count for nothing.
ROUND_TOKEN = STRING_TOKEN + r'|[()]|[^()"]++'
EXPRESSION_TOKEN = STRING_TOKEN + r'|[()\[\]?:]|[^()\[\]?:"]++'

_NUMBERS = "array<int>"
_PAIRS = "array<struct<place:int,partner:int,level:int>>"
_NONE = 2**31 - 1  # no array is that long


def running(values: Column, add: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Running sums of an array of numbers.

    Pass k adds to each value the one 2^k places before it; the passes double the reach until it
    spans the array, so n values take n * log2(n) additions and no array grows.
    """
    # an aggregate copies its array in every pass, so there is none whose reach is past the end
    reaches = F.expr("transform(sequence(0, 30), k -> shiftleft(1, k))")

    def double(sums: Column, reach: Column) -> Column:
        rest = F.size(sums) - reach
        return F.concat(F.slice(sums, F.lit(1), reach), F.zip_with(F.slice(sums, reach + 1, rest), F.slice(sums, F.lit(1), rest), add))

    return let(values.cast(_NUMBERS), lambda v: F.aggregate(F.filter(reaches, lambda r: r < F.size(v)), v, double))


def steps_of(tokens: Column, opens: str, closes: str, whole: bool = False) -> Column:
    """+1, -1 or 0 for each piece: by its last character, or by the ``whole`` piece."""

    def step(token: Column) -> Column:
        mark = token if whole else F.right(token, F.lit(1))
        return F.when(mark.isin(*opens), 1).when(mark.isin(*closes), -1).otherwise(0)

    return F.transform(tokens, step).cast(_NUMBERS)


# Pairs of numbers packed into one sort as plain numbers; structs would be compared field by field.
def packed(high: Column, low: Column) -> Column:
    return F.shiftleft(high.cast("bigint"), 32) + low


def upper(key: Column) -> Column:
    return F.shiftright(key, 32).cast("int")


def lower(key: Column) -> Column:
    return key.bitwiseAND(F.lit(2**32 - 1)).cast("int")


def pairs(steps: Column) -> Column:
    """(place, partner, level) of every bracket, by place; partner is null where it has none.

    Places count from 0.  The level of a bracket is the depth inside of it.
    """

    def level(steps: Column, sums: Column, i: Column) -> Column:
        return F.get(sums, i) + F.when(F.get(steps, i) < 0, 1).otherwise(0)

    def levelled(sums: Column, steps: Column) -> Column:
        places = F.transform(steps, lambda step, i: F.when(step != 0, packed(level(steps, sums, i), i)))
        return F.sort_array(F.filter(places, lambda key: key.isNotNull()))

    def paired(keys: Column, sums: Column, steps: Column) -> Column:
        def one(key: Column, i: Column) -> Column:
            # the place before the first is -1, which get() answers with null, as it does past the end
            after, before = F.get(keys, i + 1), F.get(keys, i - 1)
            partner = F.when(
                F.get(steps, lower(key)) > 0, F.when((upper(after) == upper(key)) & (F.get(steps, lower(after)) < 0), lower(after))
            ).when((upper(before) == upper(key)) & (F.get(steps, lower(before)) > 0), lower(before))
            return packed(lower(key), F.coalesce(partner, F.lit(_NONE)))

        def placed(key: Column) -> Column:
            partner = F.nullif(lower(key), F.lit(_NONE))
            return F.struct(upper(key).alias("place"), partner.alias("partner"), level(steps, sums, upper(key)).alias("level"))

        return F.transform(F.sort_array(F.transform(keys, one)), placed).cast(_PAIRS)

    return let(steps, lambda s: let(running(s), lambda sums: let(levelled(sums, s), lambda keys: paired(keys, sums, s))))


def joined(tokens: Column, start: Column, stop: Column) -> Column:
    """The text of the pieces start .. stop - 1, counted from 0."""
    return F.array_join(F.slice(tokens, start + 1, F.greatest(stop - start, F.lit(0))), "")


def outermost(blocks: Column) -> Column:
    """Of blocks (start, stop, ..) by their start those that no earlier one reaches over; a block whose
    ``stop`` is null takes everything behind it."""

    def kept(own: Column) -> Column:
        reach = F.transform(own, lambda b: F.coalesce(b["stop"], F.lit(2**31 - 1)))
        furthest = running(reach, lambda a, b: F.greatest(a, b))
        return let(
            furthest,
            lambda far: F.filter(own, lambda b, i: F.coalesce(F.get(far, i - 1) < b["start"], F.lit(True))),
        )

    return let(blocks, kept)


def covered(steps: Column, starts: Callable[[Column], Column], closed: bool = False) -> Column:
    """(start, stop) of the outermost blocks whose opening place passes ``starts``.

    Blocks of the kind inside of another one belong to it; ``stop`` is null for a block that never
    closes, which takes everything behind it, or doesn't count where blocks have to be ``closed``.
    """

    def spans(found: Column) -> Column:
        blocks = F.filter(
            F.transform(found, lambda b: F.struct(b["place"].alias("start"), b["partner"].alias("stop"))),
            lambda b: (b["stop"] > b["start"] if closed else b["stop"].isNull() | (b["stop"] > b["start"])) & starts(b["start"]),
        )
        return outermost(blocks)

    return let(pairs(steps), spans)


def blocks_behind(text: Column, head: str, consumed: str, simple: str) -> Column:
    """Every head with the block of braces behind it, as an array of texts.

    ``head`` is the pattern in front of the opening brace, ``consumed`` what a head takes away from the
    search for the next one, from that brace on; so heads inside of a block are found as well.  A block
    that never closes ends where the next head begins.

    Mostly every block closes before the next head: then the pattern ``simple`` cuts each from the
    text between two heads, which reads the text once.  Else one pass over all braces of the text finds
    the brace that closes each block, at any depth.
    """
    # a look at one letter passes over most places faster than a word's edge does
    search = V.OPERATION_INITIAL + head + consumed
    matches, between = all_matches(text, search), F.split(text, search, -1)

    def braces(own: Column) -> Column:
        """Number of braces; only the exact way counts them, since it reads the whole text for that."""
        size = F.length(own)
        return 2 * size - F.length(F.replace(own, F.lit("{"), F.lit(""))) - F.length(F.replace(own, F.lit("}"), F.lit("")))

    def own_parts(found: Column, rest: Column) -> Column:
        def part(match: Column, i: Column) -> Column:
            name = F.regexp_extract(match, "^" + head, 0)
            behind = F.concat(F.substr(match, F.length(name) + 1), F.get(rest, i + 1))
            return F.struct(name.alias("head"), behind.alias("behind"))

        return F.transform(found, part)

    def exact(parts: Column, rest: Column) -> Column:
        def cut(pieces: Column, found: Column, upto: Column) -> Column:
            def one(part: Column, i: Column) -> Column:
                place = braces(F.get(rest, 0)) + F.coalesce(F.get(upto, i - 1), F.lit(0)) + braces(part["head"])
                stop = F.get(found, place)["partner"]
                return F.concat(
                    part["head"],
                    F.when(stop > place, F.concat(F.lit("{"), joined(pieces, place + 1, stop + 1)))
                    .otherwise(F.get(F.split(part["behind"], V.OPERATION_HEAD + r"\{", 2), 0)),
                )

            return F.transform(parts, one)

        return let(
            all_matches(text, BRACE_PIECE),
            lambda pieces: let(
                pairs(steps_of(pieces, "{", "}")),
                lambda found: let(
                    running(F.transform(parts, lambda p: braces(p["head"]) + braces(p["behind"]))),
                    lambda upto: cut(pieces, found, upto),
                ),
            ),
        )

    def read(parts: Column, rest: Column) -> Column:
        closed = F.transform(parts, lambda p: F.regexp_extract(p["behind"], "^" + simple, 0))
        return let(
            closed,
            lambda c: F.when(F.exists(c, lambda x: x == ""), exact(parts, rest)).otherwise(
                F.zip_with(parts, c, lambda p, x: F.concat(p["head"], x))
            ),
        )

    return let(
        matches,
        lambda m: F.when(F.size(m) > 0, let(between, lambda rest: let(own_parts(m, rest), lambda parts: read(parts, rest))))
        .otherwise(F.array().cast("array<string>")),
    )
