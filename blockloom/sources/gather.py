"""Draws that go to the data: drawn blocks and windows are read from their files by the tasks that return them.

A draw is a number among all blocks, or a place in the token stream. Draws, a few bytes each, are dealt to tasks by
ranges of that number, in order; a task opens the files of its range and takes what was drawn. Blocks never move. Which
file holds a number follows from the list of files with their sizes, which is small beside what they hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.ipc as ipc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.sources.storage import locate

TOKEN_BYTES = 4
TASK_BYTES = 128 << 20
BATCH_BYTES = 4 << 20
#: Windows that lie within so many lengths of each other are read at once.
NEAR = 4
ROWS_AT_ONCE = 512


def _dealt(wanted: DataFrame, n_draws: int, draw_bytes: int) -> DataFrame:
    """The draws by ranges of ``target``; tasks go by what the draws return, not by the bytes of the draws."""
    tasks = max(1, -(-n_draws * draw_bytes // TASK_BYTES))
    return wanted.select("step", "slot", "target").repartitionByRange(tasks, "target").sortWithinPartitions("target", "step", "slot")


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel().astype(np.int32)))


class Stream:
    """Flat token files in order as one stream."""

    def __init__(self, files: list[tuple[str, int]]):
        self.uris = [uri for uri, _ in files]
        self.starts = np.cumsum([0, *(size // TOKEN_BYTES for _, size in files)])
        self.opened: tuple[int, object] = (-1, None)

    def _file(self, number: int):
        if self.opened[0] != number:
            system, inside = locate(self.uris[number])
            self.opened = (number, system.open_input_file(inside))
        return self.opened[1]

    def __call__(self, start: int, n: int) -> np.ndarray:
        parts, number = [], int(np.searchsorted(self.starts, start, "right")) - 1
        while n:
            take = min(n, int(self.starts[number + 1]) - start)
            if take:
                data = self._file(number).read_at(take * TOKEN_BYTES, (start - int(self.starts[number])) * TOKEN_BYTES)
                parts.append(np.frombuffer(data, "<u4"))
            start, n, number = start + take, n - take, number + 1
        found = np.concatenate(parts)
        if found.max() > np.iinfo(np.int32).max:
            raise ValueError("token id above the signed 32-bit range")
        return found


def gather_windows(wanted: DataFrame, n_draws: int, files: list[tuple[str, int]], block_size: int) -> DataFrame:
    """``(step, slot, start, input_ids, labels)`` for draws ``(step, slot, target)``; a window is read once."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(files)
        rows = max(1, BATCH_BYTES // (2 * TOKEN_BYTES * block_size))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                targets = part.column(2).to_numpy()
                near = np.flatnonzero(np.diff(targets, prepend=targets[0]) > NEAR * block_size)
                windows = []
                for a, b in zip([0, *near.tolist()], [*near.tolist(), targets.size]):
                    low = int(targets[a])
                    held = stream(low, int(targets[b - 1]) - low + block_size + 1)
                    windows.append(held[(targets[a:b] - low)[:, None] + np.arange(block_size + 1)])
                found = np.concatenate(windows)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, _lists(found[:, :-1]), _lists(found[:, 1:])], ["step", "slot", "start", "input_ids", "labels"])

    schema = "step BIGINT, slot BIGINT, start BIGINT, input_ids ARRAY<INT>, labels ARRAY<INT>"
    return _dealt(wanted, n_draws, 2 * TOKEN_BYTES * block_size).mapInArrow(each, schema)


def count_rows(files: DataFrame) -> DataFrame:
    """Add ``n_rows`` to files ``(path, layout, …)`` from Parquet footers and Arrow batch headers; no data is read."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, layout in zip(batch.column("path").to_pylist(), batch.column("layout").to_pylist()):
                system, inside = locate(path)
                found.append(ds.dataset(inside, filesystem=system, format="ipc" if layout == "arrow" else layout).count_rows())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, "n_rows"])

    fields = ", ".join(f"`{n}` {t}" for n, t in files.dtypes)
    return files.mapInArrow(each, f"{fields}, n_rows BIGINT")


def _parts(path: str, layout: str, rows: np.ndarray) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches of a shard with the number of their first row; parts without a wanted row are passed over."""
    system, inside = locate(path)
    names = ["input_ids", "labels"]
    with system.open_input_file(inside) as source:
        if layout == "arrow":
            reader, first = ipc.open_file(source), 0
            for i in range(reader.num_record_batches):
                batch = reader.get_batch(i).select(names)
                yield first, batch
                first += batch.num_rows
            return
        file, first = pq.ParquetFile(source), 0
        for i in range(file.metadata.num_row_groups):
            n = file.metadata.row_group(i).num_rows
            if np.searchsorted(rows, first) < np.searchsorted(rows, first + n):
                at = first
                for batch in file.iter_batches(ROWS_AT_ONCE, row_groups=[i], columns=names):
                    yield at, batch
                    at += batch.num_rows
            first += n


def gather_blocks(wanted: DataFrame, n_draws: int, shards: list[tuple[str, str, int]], block_size: int) -> DataFrame:
    """``(step, slot, row_index, input_ids, labels)`` for draws ``(step, slot, target)``.

    ``shards`` holds path, layout and number of rows of each shard file, in order; ``target`` counts rows over all.
    """
    paths = [(path, layout) for path, layout, _ in shards]
    starts = np.cumsum([0, *(n for _, _, n in shards)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            targets = batch.column(2).to_numpy()
            shard = np.searchsorted(starts, targets, "right") - 1
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), targets.size]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                rows = targets[a:b] - starts[shard[a]]
                for first, part in _parts(*paths[shard[a]], rows):
                    low, high = np.searchsorted(rows, [first, first + part.num_rows])
                    for at in range(low, high, ROWS_AT_ONCE):
                        end = min(high, at + ROWS_AT_ONCE)
                        drawn = part.take(pa.array(rows[at:end] - first))
                        yield pa.RecordBatch.from_arrays(
                            [*batch.slice(a + at, end - at).columns, drawn.column("input_ids"), drawn.column("labels")],
                            ["step", "slot", "row_index", "input_ids", "labels"])

    schema = "step BIGINT, slot BIGINT, row_index BIGINT, input_ids ARRAY<INT>, labels ARRAY<INT>"
    return _dealt(wanted, n_draws, 2 * TOKEN_BYTES * block_size).mapInArrow(each, schema)
