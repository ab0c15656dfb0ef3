"""Groups of rows for page-wise steps: dealt out by key, sorted, and handed over in whole groups.

Gathering a group's rows as an array sorts and holds them several times over. Here rows
move flat, are sorted once where they lie, and reach Python in Arrow batches of the
session's size; a batch that ends inside a group leaves its last rows to the next one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def dealt(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with those of equal ``keys`` next to each other, in ``order``."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers that are equal where values are; nulls are equal to each other, and so are NaNs."""
    try:
        return column.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    except (pa.ArrowNotImplementedError, pa.ArrowInvalid):  # structs and lists
        known: dict[str, int] = {}
        return np.array([known.setdefault(repr(v), len(known)) for v in column.to_pylist()], np.int64)


def starts(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """Where groups of neighbouring rows with equal ``columns`` begin."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for c in columns:
        codes = _codes(batch.column(c))
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def whole(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups, each with the bounds of its groups."""
    held: list[pa.RecordBatch] = []  # of one group
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(starts(batch, keys)[-1])
        if not last and (not held or len(starts(_one([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]), keys)) == 1):
            held.append(batch)
            continue
        ready = _one([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
        yield ready, np.append(starts(ready, keys), ready.num_rows)
    if held:
        ready = _one(held)
        yield ready, np.append(starts(ready, keys), ready.num_rows)
