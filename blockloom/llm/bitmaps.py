"""Sets of 64-bit numbers as bitmaps of a fixed size that every task can hold.

A number has two places in a bitmap. A bitmap never denies a number that it was given; the fuller it is, the more others
it admits, so it only spares work and the callers decide exactly later. Its size does not depend on the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.session import passing_shuffles

BITS = 26
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SCHEMA = "at long, bits long"


def empty() -> np.ndarray:
    return np.zeros(1 << BITS - 6, np.uint64)


def places(numbers: np.ndarray) -> list[np.ndarray]:
    """The two places of each number."""
    mixed = numbers ^ (numbers >> np.uint64(31))
    return [((mixed + np.uint64(1)) * np.uint64(m)) >> np.uint64(64 - BITS) for m in FACTORS]


def has(bitmap: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    found = np.ones(numbers.size, bool)
    for place in places(numbers):
        found &= (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return found


def put(bitmap: np.ndarray, numbers: np.ndarray) -> None:
    for place in places(numbers):
        np.bitwise_or.at(bitmap, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))


def held(bitmap: np.ndarray) -> pa.RecordBatch:
    """What is set, as rows ``at, bits``."""
    at = np.flatnonzero(bitmap)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(bitmap[at].view(np.int64))], ["at", "bits"])


def merged(parts: DataFrame) -> np.ndarray:
    """The bitmap of the rows ``at, bits`` of many tasks: at most 2^(``BITS`` - 6) rows reach the driver."""
    with passing_shuffles(parts.sparkSession):
        found = parts.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    result = empty()
    result[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return result


def of(numbers: DataFrame) -> np.ndarray:
    """The bitmap of a column of longs."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = empty()
        for batch in batches:
            put(bitmap, batch.column(0).to_numpy().view(np.uint64))
        yield held(bitmap)

    return merged(numbers.mapInArrow(each, SCHEMA))


# ---------------------------------------------------------------- counting cells

CELL_BITS = 40
#: At least so many buckets, so that a cell's number within its bucket has 32 bits.
BUCKETS = 256
HELD_CELLS = 1 << 21
CELL_ROWS = "bucket int, cells binary, counts binary"


def cells(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - CELL_BITS)


def cells_of(values: np.ndarray) -> np.ndarray:
    """The cells of a column of 64-bit hashes, or of 32-bit ones, which are cells themselves."""
    return cells(values.view(np.uint64)) if values.dtype == np.int64 else values.view(np.uint32).astype(np.uint64)


def shared_items(lists: pa.ListArray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of hashes the items that the bitmap holds: their list, their place in it, and the hash."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    items = lists.flatten().to_numpy()
    owner = np.repeat(np.arange(sizes.size), sizes)
    at = np.arange(items.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    held_ = np.flatnonzero(has(bitmap, cells_of(items)))
    return owner[held_], at[held_].astype(np.int32), items[held_]


def packed_cells(found: list[np.ndarray], counts: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Sums of cells, one row per bucket: 32-bit numbers within the bucket with a count byte each, at most 255."""
    each, total = np.concatenate(found), np.concatenate(counts)
    bucket = each % np.uint64(buckets)
    order = np.lexsort((each, bucket))
    each, total, bucket = each[order], total[order], bucket[order]
    first = np.flatnonzero(np.diff(each, prepend=~each[:1]))
    total = np.minimum(np.add.reduceat(total, first), 255).astype(np.uint8)
    inner, bucket = (each[first] // np.uint64(buckets)).astype("<u4"), bucket[first].astype(np.int32)
    cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), bucket.size).astype(np.int32)
    return pa.RecordBatch.from_arrays([
        pa.array(bucket[cut[:-1]]),
        pa.Array.from_buffers(pa.binary(), cut.size - 1, [None, pa.py_buffer(cut * np.int32(4)), pa.py_buffer(inner)]),
        pa.Array.from_buffers(pa.binary(), cut.size - 1, [None, pa.py_buffer(cut), pa.py_buffer(total)])],
        ["bucket", "cells", "counts"])


def frequent(rows: DataFrame, least: int, buckets: int) -> np.ndarray:
    """The bitmap of the cells that all ``packed_cells`` together count ``least`` times or more; at most 255."""
    def summed(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        inner = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table["cells"]])
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table["counts"]])
        order = np.argsort(inner, kind="stable")
        inner = inner[order]
        first = np.flatnonzero(np.diff(inner.astype(np.int64), prepend=-1))
        total = np.add.reduceat(counts[order], first, dtype=np.int64)
        bitmap = empty()
        put(bitmap, inner[first[total >= least]].astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket))
        return pa.Table.from_batches([held(bitmap)])

    return merged(rows.groupBy("bucket").applyInArrow(summed, SCHEMA))


def repeated(lists: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The bitmap of the cells of numbers that occur twice or more in a column of lists of hashes."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            numbers = cells_of(batch.column(0).flatten().to_numpy())
            waiting.append(numbers)
            size += numbers.size
            if size >= HELD_CELLS:
                yield packed_cells(waiting, [np.ones(size, np.int64)], buckets)
                waiting, size = [], 0
        if size:
            yield packed_cells(waiting, [np.ones(size, np.int64)], buckets)

    return frequent(lists.mapInArrow(each, CELL_ROWS), 2, buckets)
