"""Fitting linear-chain conditional random fields by gradient ascent on the log-likelihood.

Emissions are sums of weights over features, so the gradient of a chain is what its given labels
count minus what the model expects, from the exact forward-backward sums of ``chains``.  Fitting
runs on a bounded sample of labelled rows; scoring runs in tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from opatlas.llm.chains import sum_paths


@dataclass
class Field:
    """weights: features x labels; start: labels; moves: labels x labels, all in logarithms."""

    weights: np.ndarray
    start: np.ndarray
    moves: np.ndarray

    def marginals(self, first: np.ndarray, emissions: np.ndarray) -> np.ndarray:
        return self._summed(first, emissions).marginals

    def _summed(self, first: np.ndarray, emissions: np.ndarray):
        factors = np.exp(emissions - emissions.max(axis=1, keepdims=True, initial=-np.inf))
        return sum_paths(first, factors, np.exp(self.start), np.exp(self.moves))


@dataclass
class Batch:
    """Chains ``first[s]:first[s+1]`` with given labels; ``counts`` weighs each chain.

    ``emit(weights)`` gives emissions per place, ``collect(values)`` sums values per place back
    into features.
    """

    first: np.ndarray
    labels: np.ndarray
    counts: np.ndarray
    emit: Callable[[np.ndarray], np.ndarray]
    collect: Callable[[np.ndarray], np.ndarray]


def fit(
    batches: list[Batch], n_features: int, n_labels: int, rounds: int, rate: float, decay: float
) -> Field:
    """Adam over the batches; ``decay`` pulls weights towards 0 (an L2 prior)."""
    field = Field(np.zeros((n_features, n_labels)), np.zeros(n_labels), np.zeros((n_labels, n_labels)))
    values = [field.weights, field.start, field.moves]
    means = [np.zeros_like(v) for v in values]
    squares = [np.zeros_like(v) for v in values]
    step = 0
    for turn in range(rounds):
        for batch in batches:
            step += 1
            gradient = _gradient(field, batch, n_labels)
            here = rate * (1 - turn / rounds) + 0.05 * rate
            for value, g, mean, square in zip(values, gradient, means, squares, strict=True):
                g = g - decay * value
                mean += 0.1 * (g - mean)
                square += 0.01 * (g * g - square)
                value += here * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return field


def _gradient(field: Field, batch: Batch, k: int) -> list[np.ndarray]:
    first, labels = batch.first, batch.labels
    lengths = np.diff(first)
    total = max(1.0, float((batch.counts * lengths).sum()))
    weight = np.repeat(batch.counts, lengths) / total
    given = np.zeros((len(labels), k))
    given[np.arange(len(labels)), labels] = 1.0
    heads = first[:-1][lengths > 0]
    inner = np.ones(len(labels), bool)
    inner[heads] = False
    later = np.flatnonzero(inner)
    emissions = batch.emit(field.weights)
    marginals = np.empty_like(emissions)
    expected = np.zeros((k, k))
    for value in np.unique(batch.counts):  # chains of one weight together: pairs come summed
        chains = np.flatnonzero((batch.counts == value) & (lengths > 0))
        if not len(chains):
            continue
        places = np.concatenate([np.arange(first[c], first[c + 1]) for c in chains])
        own_first = np.concatenate([[0], np.cumsum(lengths[chains])])
        summed = field._summed(own_first, emissions[places])
        marginals[places] = summed.marginals
        expected += summed.pairs * value / total
    moved = np.zeros((k, k))
    np.add.at(moved, (labels[later - 1], labels[later]), weight[later])
    difference = (given - marginals) * weight[:, None]
    return [batch.collect(difference), difference[heads].sum(axis=0), moved - expected]
