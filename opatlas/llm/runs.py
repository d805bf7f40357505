"""Runs of equal keys in a sorted stream of Arrow batches, and sorting a table into such runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of one key in one task, next to each other."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.RecordBatch]:
    """The rows of each key, which must come next to each other; only one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for values in columns:
            new[1:] |= values[1:] != values[:-1]
        new[0] = last is not None and tuple(v[0] for v in columns) != last
        cuts = np.concatenate([[0], np.flatnonzero(new), [batch.num_rows]])
        for begin, stop in zip(cuts[:-1], cuts[1:], strict=True):
            if begin == stop:  # the first row opens a new run
                yield joined(held)
                held = []
                continue
            if begin and held:
                yield joined(held)
                held = []
            held.append(batch.slice(begin, stop - begin))
        last = tuple(v[-1] for v in columns)
    if held:
        yield joined(held)


def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)
