"""Scalar text functions on operation text, all of them Column expressions.

Functions that read their input several times are given a bound value (``let``), so that
neither a long chain nor a filter pushed below it evaluates a regular expression twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from opatlas import fixed_values as V
from opatlas.functions import brackets as B
from opatlas.functions.columns import all_matches, let, replace_all

JSON_ESCAPES = [("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\")]
SCRIPT_ESCAPES = [
    ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\'", "'"), ("\\\\", "\\"),
]
CONSTANT_ESCAPES = [("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\'", "'"), ("\\\\", "\\")]

_AFTER_CLOSING_BRACE = r"(?<=\})"


def unescape_json(text: Column) -> Column:
    return replace_all(text, JSON_ESCAPES)


def unescape_script(text: Column) -> Column:
    return replace_all(text, SCRIPT_ESCAPES)


def unescape_constant(text: Column) -> Column:
    return replace_all(text, CONSTANT_ESCAPES)


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def drop_comments(text: Column) -> Column:
    """Text without ``#`` comments; a ``#`` inside of a string starts none."""
    dropped = F.regexp_replace(text, V.STRING_OR_COMMENT, "$1")
    return F.when(text.contains("#"), dropped).otherwise(text)


def capitalize(text: Column) -> Column:
    """Upper-case the first letter and leave the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2**31 - 1))


_CALL = ".concat("
# A call's opening, a run of brackets of one kind, or text without either.
_CALL_PIECE = r"\.concat\(|\(++|\)++|(?:[^().]++|\.(?!concat\())++"
# With more levels than this the levels that a run closes are all listed.
_FEW_LEVELS = 16


def _calls(steps: Column, depths: Column, is_opening: Callable[[Column], Column]) -> Column:
    """(start, stop, rest) of the outermost calls: the pieces where each opens and closes, and how many
    brackets of the closing piece are not its own; ``stop`` is null for a call that never closes.

    A call closes at the first piece behind it that closes its level.  Only the openings of calls and
    the levels that calls have are sorted, however many brackets stand in between.
    """
    openings = F.filter(
        F.transform(depths, lambda depth, i: F.when(is_opening(i), B.packed(depth, i))), lambda key: key.isNotNull()
    )

    def closings(levels: Column) -> Column:
        def closed(depth: Column, i: Column) -> Column:
            run = F.sequence(depth + 1, depth - F.get(steps, i))
            kept = F.when(F.size(levels) > _FEW_LEVELS, run).otherwise(F.filter(run, lambda x: F.array_contains(levels, x)))
            return F.when(F.get(steps, i) < 0, F.transform(kept, lambda level: B.packed(level, i)))

        return F.flatten(F.filter(F.transform(depths, closed), lambda keys: keys.isNotNull()))

    def calls(keys: Column) -> Column:
        def one(key: Column, i: Column) -> Column:
            after = F.get(keys, i + 1)
            stop = F.when(B.upper(after) == B.upper(key), B.lower(after))
            rest = B.upper(key) - 1 - F.get(depths, stop)
            return F.when(is_opening(B.lower(key)), F.struct(B.lower(key).alias("start"), stop.alias("stop"), rest.alias("rest")))

        return B.outermost(F.sort_array(F.filter(F.transform(keys, one), lambda call: call.isNotNull())))

    return let(
        openings,
        lambda own: let(
            let(F.array_distinct(F.transform(own, B.upper)), closings),
            lambda ends: let(F.sort_array(F.concat(own, ends)), calls),
        ),
    )


def flatten_concat(text: Column) -> Column:
    """Replace every ``.concat(...)`` by the string literals among its arguments.

    Arguments reach to the matching parenthesis, at any depth; a call that never closes takes the
    rest of the text but its last character.
    """

    def literals(arguments: Column) -> Column:
        return F.array_join(all_matches(arguments, '"(' + V.STRING_RUN + ')"', 1), "")

    def step(piece: Column) -> Column:
        size = F.length(piece)
        return F.when(piece == _CALL, 1).when(piece.startswith("("), size).when(piece.startswith(")"), -size).otherwise(0)

    def flat(parts: Column, calls: Column) -> Column:
        n = F.size(parts)

        def behind(call: Column, stop: Column) -> Column:
            """The text from a call's end up to a piece; brackets of its closing piece may be left."""
            begin = F.coalesce(F.when(call.isNotNull(), F.coalesce(call["stop"] + 1, n)), F.lit(0))
            return F.concat(F.repeat(F.lit(")"), F.coalesce(call["rest"], F.lit(0))), B.joined(parts, begin, stop))

        def one(call: Column, i: Column) -> Column:
            arguments = B.joined(parts, call["start"] + 1, F.coalesce(call["stop"], n))
            unclosed = F.left(arguments, F.greatest(F.length(arguments) - 1, F.lit(0)))
            # an opening with nothing behind it is no call
            found = F.when(call["start"] + 1 == n, _CALL).otherwise(let(F.when(call["stop"].isNull(), unclosed).otherwise(arguments), literals))
            return F.concat(behind(F.get(calls, i - 1), call["start"]), found)

        return F.concat(F.array_join(F.transform(calls, one), ""), behind(F.get(calls, F.size(calls) - 1), n))

    def read(parts: Column) -> Column:
        steps = F.transform(parts, step)
        calls = let(
            steps, lambda s: let(B.running(s), lambda depths: _calls(s, depths, lambda place: F.get(parts, place) == _CALL))
        )
        return let(calls, lambda found: flat(parts, found))

    return F.when(text.contains(_CALL), let(all_matches(text, _CALL_PIECE), read)).otherwise(text)


def drop_script_syntax(text: Column) -> Column:
    """Remove string joins, template holes and conditionals, then unescape."""
    text = F.regexp_replace(text, V.JOINED_BOTH_SIDES, " ")
    text = F.regexp_replace(text, V.JOINED_RIGHT, " ")
    text = F.regexp_replace(text, V.JOINED_LEFT, " ")
    text = F.regexp_replace(text, V.TEMPLATE_HOLE, "")
    text = F.regexp_replace(text, V.CONDITIONAL, "")
    return unescape_script(text)


def keep_operation_tokens(text: Column) -> Column:
    """Keep tokens an operation may hold; drop comments, script words and all else."""
    tokens = F.filter(
        all_matches(text, V.KEPT_TOKEN),
        lambda t: ~t.isin(V.SCRIPT_ONLY_WORDS) & ~t.startswith("#"),
    )
    return F.array_join(tokens, "")


def _braces(text: Column, brace: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(brace), F.lit("")))


def _depth_after(depth: Column, piece: Column) -> Column:
    return depth + _braces(piece, "{") - F.when(piece.endswith("}"), 1).otherwise(0)


def is_balanced(text: Column) -> Column:
    """Has braces, closes all of them, and never closes one too many."""
    broken = -(2**30)
    pieces = F.split(text, _AFTER_CLOSING_BRACE, -1)
    lowest_first = F.aggregate(
        pieces,
        F.lit(0),
        lambda depth, piece: F.when(depth < 0, F.lit(broken)).otherwise(_depth_after(depth, piece)),
    )
    same_count = (_braces(text, "{") == _braces(text, "}")) & text.contains("{")
    return F.when(same_count, lowest_first == 0).otherwise(False)


def trim_after_last_block(text: Column) -> Column:
    """Drop what follows the last closing brace of balanced text."""
    return F.when(is_balanced(text), F.regexp_replace(text, r"(?<=\})[^}]*+$", "")).otherwise(text)


def clean_script_text(text: Column) -> Column:
    """Turn text cut out of a script into operation text."""
    return let(
        text,
        lambda raw: let(
            flatten_concat(raw),
            lambda flat: let(
                keep_operation_tokens(drop_script_syntax(flat)),
                lambda kept: collapse_spaces(trim_after_last_block(kept)),
            ),
        ),
    )
