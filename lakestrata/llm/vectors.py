"""What the two vector operators share: which rows take part, Arrow lists as matrices, groups as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components are finite numbers."""
    value = lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))
    finite = F.forall(vector, lambda x: ~F.isnan(value(x)) & (F.abs(value(x)) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def usual_width(rows: DataFrame, column: str) -> int:
    """The most frequent number of components; the larger of two that are as frequent; 0 without rows."""
    sizes = rows.groupBy(F.size(column).alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("n")).first()
    return sizes["n"] if sizes else 0


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1)


def per_group(rows: DataFrame, keys: list[str], run: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Call ``run`` with the rows of each group in turn; ``rows`` must be dealt and sorted by ``keys``, and groups bounded."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(max(0, batch.num_rows - 1), bool)
            for c in columns:
                change |= c[1:] != c[:-1]
            start = 0
            for stop in [*(np.flatnonzero(change) + 1).tolist(), batch.num_rows]:
                if start == stop:
                    continue
                key = tuple(c[start] for c in columns)
                if waiting and key != last:
                    yield from run(pa.Table.from_batches(waiting))
                    waiting = []
                waiting.append(batch.slice(start, stop - start))
                last, start = key, stop
        if waiting:
            yield from run(pa.Table.from_batches(waiting))

    return rows.mapInArrow(stream, schema)
