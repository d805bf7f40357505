"""Exact sums over all label paths of linear chains, for many sequences at once.

The forward and backward recursions run over blocks of at most ``BLOCK`` places: first the product of
transfer matrices of every block that hands something on, all such blocks side by side (sequences of one
block have none), then one small step per block along each sequence, then the places inside
the blocks, again side by side.  A sequence of any length is
summed exactly, in about 2 * BLOCK + length / BLOCK array operations instead of ``length``.
Vectors are rescaled at every place and the scales' logarithms kept, so nothing underflows.

Arrays hold a row for each label, and in it the first places of all blocks, then their second places,
and so on: every step reads and writes neighbouring numbers, and no array operation is as short as the
number of labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK, LEAST_BLOCK = 512, 64
# Blocks get shorter where there are few places: about so many shall stand side by side.
ABREAST = 512


@dataclass
class Summed:
    """log_sum: per sequence; marginals: per place (or code) and label; pairs: expected transitions;
    starts: expected labels of first places."""

    log_sum: np.ndarray
    marginals: np.ndarray | None = None
    pairs: np.ndarray | None = None
    starts: np.ndarray | None = None


class _Blocks:
    """Sequences cut into blocks; blocks are kept longest first, so the active ones are a prefix.

    ``slots`` has the places in the order of the arrays; step t has ``offset[t]:offset[t + 1]`` of them.
    """

    def __init__(self, first: np.ndarray, most: int) -> None:
        lengths = np.diff(first)
        per = -(-lengths // most)
        seq = np.repeat(np.arange(len(lengths)), per)
        number = np.arange(len(seq)) - np.repeat(np.cumsum(per) - per, per)
        begin = first[:-1][seq] + number * most
        size = np.minimum(most, first[1:][seq] - begin)
        order = np.argsort(-size, kind="stable")
        self.size, self.leads, self.seq = size[order], (number == 0)[order], seq[order]
        self.alone, self.ends = (per[seq] == 1)[order], (number == per[seq] - 1)[order]
        self.active = np.searchsorted(-self.size, -np.arange(int(size.max(initial=0))))
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        self.block = np.arange(self.offset[-1]) - np.repeat(self.offset[:-1], self.active)
        self.slots = begin[order][self.block] + np.repeat(np.arange(len(self.active)), self.active)
        place = np.empty(len(order), np.int64)  # from (sequence, number) to the kept order
        place[order] = np.arange(len(order))
        starts = np.cumsum(per) - per
        longest = int(per.max(initial=0))
        long_first = np.argsort(-per, kind="stable")
        counts = per[long_first]
        self.along = [
            place[starts[long_first[: int((counts > k).sum())]] + k] for k in range(longest)
        ]


def _normed(x: np.ndarray, axes: tuple[int, ...] = (0,)) -> np.ndarray:
    return x / x.sum(axis=axes, keepdims=True)


def _transfers(blocks: _Blocks, handing: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Scaled transfer matrices of some blocks (labels x labels x blocks)."""
    k = len(moves)
    out = np.empty((k, k, len(handing)), moves.dtype)
    out[:] = np.eye(k, dtype=moves.dtype)[:, :, None]
    size, leads, across = blocks.size[handing], blocks.leads[handing], np.ascontiguousarray(moves.T)
    for t in range(int(size.max(initial=0))):
        active = int(np.searchsorted(-size, -t))  # longest first
        here = out[:, :, :active]
        moved = np.matmul(across, here)
        if t == 0:
            moved = np.where(leads[:active], here, moved)
        moved *= weights[:, blocks.offset[t] + handing[:active]]
        out[:, :, :active] = moved if t % 8 else _normed(moved, (0, 1))
    return out


def sum_paths(
    first: np.ndarray,
    weights: np.ndarray,
    start: np.ndarray,
    moves: np.ndarray,
    marginals: bool = True,
    codes: np.ndarray | None = None,
) -> Summed:
    """Sums over the label paths of sequences ``first[s]:first[s+1]``.

    ``weights`` (places x labels), ``start`` (labels) and ``moves`` (labels x labels) are
    positive factors, not logarithms.  A sequence without places has the sum 1.  Single-precision
    ``weights`` are summed in single precision, but for the logarithms.  With ``codes``, place i has
    the weights ``weights[codes[i]]``, and marginals are summed for each code.
    """
    k, n = weights.shape[1], int(first[-1])
    kind = weights.dtype
    start, moves = start.astype(kind), moves.astype(kind)
    across = np.ascontiguousarray(moves.T)
    wanted = 1 << max(0, n // ABREAST).bit_length()
    blocks = _Blocks(first, min(max(LEAST_BLOCK, wanted), BLOCK))
    offset, m = blocks.offset, len(blocks.leads)
    if codes is None:
        weights = np.ascontiguousarray(weights[blocks.slots].T)
        scale = weights.max(axis=0) if n else np.ones(0, kind)
        weights /= scale
        log_scale = np.log(scale.astype(float))
    else:
        here, scale = codes[blocks.slots], weights.max(axis=1)
        n_codes, log_scale = len(weights), np.log(scale.astype(float))[here]
        weights = np.ascontiguousarray((weights / scale[:, None]).T).take(here, axis=1)
    # 1. transfer matrices; a block alone has no neighbour, and the sums need none of a last block
    handing = np.flatnonzero(~(blocks.alone if marginals else blocks.ends))
    slot = np.zeros(m, np.int64)
    slot[handing] = np.arange(len(handing))
    transfer = _transfers(blocks, handing, weights, moves)
    # 2. from block to block
    into = np.empty((k, m), kind)
    carried = np.broadcast_to((start / start.sum())[:, None], (k, len(blocks.along[0]) if m else 0))
    for number, at in enumerate(blocks.along):
        into[:, at] = carried
        if number + 1 < len(blocks.along):
            on = at[: len(blocks.along[number + 1])]
            carried = _normed(np.einsum("is,ijs->js", into[:, on], transfer[:, :, slot[on]]))
    # 3. inside the blocks
    forward, totals = np.empty((k, n), kind), np.empty(n, kind)
    for t, active in enumerate(blocks.active):
        own = slice(offset[t], offset[t + 1])
        now, total = forward[:, own], totals[own]
        if t:
            np.matmul(across, forward[:, offset[t - 1] : offset[t - 1] + active], out=now)
        else:
            now[:] = np.where(blocks.leads, into, across @ into)
        now *= weights[:, own]
        np.add.reduce(now, axis=0, out=total)
        now /= total
    logs = np.log(totals.astype(float))
    logs += log_scale
    log_sum = np.bincount(blocks.seq[blocks.block], logs, len(first) - 1).astype(float)  # whole numbers if empty
    log_sum += np.where(np.diff(first) > 0, np.log(start.sum()), 0.0)
    if not marginals:
        return Summed(log_sum)
    # 4. backward: the sum over what follows each place
    out_of = np.full((k, m), 1.0 / k, kind)
    for number in range(len(blocks.along) - 1, 0, -1):
        at = blocks.along[number]
        before = blocks.along[number - 1][: len(at)]
        out_of[:, before] = _normed(np.einsum("ijs,js->is", transfer[:, :, slot[at]], out_of[:, at]))
    pairs, follow = np.zeros((k, k)), np.flatnonzero(~blocks.leads)
    for t in range(len(blocks.active) - 1, -1, -1):
        active = blocks.active[t]
        own = slice(offset[t], offset[t + 1])
        now, behind = forward[:, own], out_of[:, :active]
        after = weights[:, own] * behind
        now *= behind  # marginals take the place of the forward sums
        norm = np.add.reduce(now, axis=0)
        now /= norm
        behind[:] = moves @ after
        behind /= np.add.reduce(behind, axis=0)
        norm *= totals[own]
        after /= norm
        if t:
            pairs += forward[:, offset[t - 1] : offset[t - 1] + active] @ after.T
        else:
            pairs += into[:, follow] @ after[:, follow].T
    starts = forward[:, :m][:, blocks.leads].sum(axis=1)
    if codes is None:
        both = np.empty((n, k), kind)
        both[blocks.slots] = forward.T
    else:
        both = np.stack([np.bincount(here, own, n_codes) for own in forward], axis=1)
    return Summed(log_sum, both, pairs * moves, starts)


def by_brute_force(
    first: np.ndarray, weights: np.ndarray, start: np.ndarray, moves: np.ndarray
) -> np.ndarray:
    """log sums by the plain recursion, for tests."""
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        total, alpha = 0.0, start.astype(float)
        for t in range(a, b):
            alpha = (alpha if t == a else alpha @ moves) * weights[t]
            total += np.log(alpha.sum())
            alpha = alpha / alpha.sum()
        out.append(total)
    return np.array(out)
