"""Vectors in Arrow columns, and work on bounded groups of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a block that one task compares with one another.
BLOCK = 192
MARGIN = 1e-9


def unit_rows(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision, one row each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_group(df: DataFrame, keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(rows) for the rows of each key together; groups must be bounded. Groups of a task share its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            at = [0]
            columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            turn = np.zeros(b.num_rows - 1, bool)
            for c in columns:
                turn |= c[1:] != c[:-1]
            if held and any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in keys):
                yield from work(pa.Table.from_batches(held))
                held = []
            at += [*(np.flatnonzero(turn) + 1).tolist(), b.num_rows]
            for i, j in zip(at, at[1:], strict=False):
                if i and held:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(i, j - i))
        if held:
            yield from work(pa.Table.from_batches(held))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def of_each_dim(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of each vector length by themselves."""
    dims = batch.column("dim").to_numpy()
    for d in np.unique(dims):
        yield batch.filter(pa.array(dims == d))
