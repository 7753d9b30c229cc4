"""Rows in and out of mapInArrow, in batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each row as a tuple of Python values, one row at a time: a batch of long texts is never held twice."""
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            yield tuple(x.as_py() for x in row)


def batches_of(found: Iterable[tuple], schema: pa.Schema, most: int = 2000, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of at most so many rows, and of about so many bytes in binary columns."""
    held, size = [], 0
    heavy = [i for i, t in enumerate(schema.types) if pa.types.is_binary(t) or pa.types.is_string(t)]

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    for row in found:
        held.append(row)
        size += sum(len(row[i]) for i in heavy if row[i] is not None)
        if len(held) >= most or size >= most_bytes:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()
