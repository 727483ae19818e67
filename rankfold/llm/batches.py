"""Rows that carry arrays: compact columns for exchanges between batches of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One dict per row, read one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Consecutive rows with one value of ``key``."""
    group: list[dict] = []
    for row in rows_of(batches):
        if group and row[key] != group[0][key]:
            yield group
            group = []
        group.append(row)
    if group:
        yield group


def record(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(schema.values())], names=list(schema)
    )


def range_slices(values: np.ndarray, buckets: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, last) of sorted ``bits``-bit values cut into equal ranges."""
    limits = np.array([(b << bits) // buckets for b in range(1, buckets)], dtype=np.uint64)
    edges = np.concatenate([[0], np.searchsorted(values, limits), [len(values)]])
    for bucket in range(buckets):
        if edges[bucket] < edges[bucket + 1]:
            yield bucket, int(edges[bucket]), int(edges[bucket + 1])


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as compressed byte planes, the lowest first."""
    values = np.ascontiguousarray(values.astype("<u8"))
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    """The integers of :func:`pack`, as int64."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), dtype=np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<i8").reshape(-1)
