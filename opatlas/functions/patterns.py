"""Pattern building: balanced blocks, and the RE2 form of a pattern."""

from __future__ import annotations

import re

# Levels a balanced pattern follows; deeper blocks are cut by ``opatlas.functions.brackets``.
BLOCK_LEVELS = 16


def balanced(open_: str, close: str, levels: int) -> str:
    """Pattern of a block from ``open_`` to its ``close``, nested up to ``levels`` deep."""
    o, c = re.escape(open_), re.escape(close)
    run = f"[^{o}{c}]*+"
    inner = run
    for _ in range(levels - 1):
        inner = f"{run}(?:{o}{inner}{c}{run})*+"
    return f"{o}{inner}{c}"


def balanced_inner(open_: str, close: str, levels: int) -> str:
    """Like :func:`balanced`, without the outer pair."""
    return balanced(open_, close, levels)[len(re.escape(open_)): -len(re.escape(close))]


def re2(pattern: str) -> str:
    """The same pattern for engines that never backtrack: no possessive marks, no look-behind.

    Look-behinds are used only to save attempts, never to decide a match.
    """
    pattern = re.sub(r"\(\?<![^()]*\)", "", pattern)
    return re.sub(r"(?<!\\)([*+?}])\+", r"\1", pattern)
