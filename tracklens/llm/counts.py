"""Counts over all documents in tables of a fixed number of buckets.

Each task adds up its own dense tables and emits them in blocks; the blocks are summed as they stream through the task
that owns them. What is shuffled grows with the number of input splits, what reaches the driver is fixed by the number
of buckets, and so is every broadcast of the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 1 << 14


def narrow(counts: np.ndarray) -> np.ndarray:
    """In the narrowest of one, two or four bytes a count."""
    return counts.astype(next(t for t in (np.uint8, np.uint16, np.uint32) if counts.max() <= np.iinfo(t).max))


def dense_counts(rows: DataFrame, add: Callable[[pa.RecordBatch, np.ndarray], None], tables: int, buckets: int) -> np.ndarray:
    """``add`` counts a batch into an array of shape (tables, buckets); returns the sum over all rows, as int64.

    ``buckets`` is a multiple of ``BLOCK``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((tables, buckets), np.uint32)
        some = False
        for b in batches:
            if b.num_rows:
                add(b, own)
                some = True
        if some:
            flat = own.reshape(-1, BLOCK)
            for i in np.flatnonzero(flat.any(axis=1)).tolist():
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([narrow(flat[i]).tobytes()], pa.binary())], names=["block", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        out = lambda: pa.record_batch([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "counts"])
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i != at:
                    if at is not None:
                        yield out()
                    at, total = i, np.zeros(BLOCK, np.int64)
                raw = c.as_buffer()
                total += np.frombuffer(raw, f"u{raw.size // BLOCK}")
        if at is not None:
            yield out()

    schema = "block int, counts binary"
    blocks = rows.mapInArrow(count, schema).repartition("block").sortWithinPartitions("block").mapInArrow(merge, schema)
    out = np.zeros((tables * buckets // BLOCK, BLOCK), np.int64)
    for r in blocks.collect():  # as many blocks as the tables have, whatever the input
        out[r.block] = np.frombuffer(r.counts, np.int64)
    return out.reshape(tables, buckets)
