"""Helpers that several operators share: tables in the shared folder and Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available

from ..sources.shared import materialise

__all__ = ["materialise", "sub_batches"]


def sub_batches(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20, max_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``max_bytes`` of ``column``.

    A single value above the bound makes a batch of its own; nothing is cut
    inside a value and no row is dropped.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if batch.num_rows <= max_rows and batch.nbytes <= max_bytes:
            yield batch
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and (total + size > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)
