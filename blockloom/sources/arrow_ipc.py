"""Arrow IPC files as a data source: ``spark.read.format("arrow_ipc")``.

Options: ``paths`` (JSON list of files or directories) or ``path``; ``split_bytes`` (files above it are read by
several tasks, each a range of record batches, while a task takes many small files); ``columns`` (JSON list of the columns to read). Files may differ in their columns: a column that a file lacks is null,
numbers take the wider type, kinds that do not combine are an error. Adds ``_file``, ``_block`` (record batch) and ``_pos`` (row in it).
"""

from __future__ import annotations

import json
import operator
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan,
    LessThanOrEqual)
from pyspark.sql.pandas.types import from_arrow_schema, from_arrow_type, to_arrow_schema

from blockloom.sources.storage import in_tasks, list_files, locate, register_source

SUFFIXES = (".arrow", ".ipc")
SCHEMA_READERS = 16
ORDER_FIELDS = [("_file", pa.string()), ("_block", pa.int64()), ("_pos", pa.int64())]
ROW_FIELD = ("_row", pa.int64())  # the place in the file; asked for with the option ``rows``


class BatchRange(InputPartition):
    def __init__(self, uri: str, first: int, last: int | None):
        self.uri, self.first, self.last = uri, first, last
        self.after: list[BatchRange] = []  # ranges that the same task reads next


def _open(uri: str, names: list[str] | None = None) -> pa.ipc.RecordBatchFileReader:
    """A file; with ``names`` only the buffers of these columns are read."""
    system, path = locate(uri)
    source = system.open_input_file(path)
    reader = pa.ipc.open_file(source)
    if names is None or set(reader.schema.names) <= set(names):
        return reader
    wanted = [i for i, name in enumerate(reader.schema.names) if name in names]
    return pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=wanted))


#: Comparisons of the order columns that spare files and record batches.
TESTS = {
    EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt,
    LessThanOrEqual: operator.le, In: lambda value, values: value in values,
}


def _rows(uri: str, numbers: range) -> list[int]:
    """Sizes of record batches, from their metadata alone."""
    system, path = locate(uri)
    reader = pa.ipc.open_file(system.open_input_file(path), options=pa.ipc.IpcReadOptions(included_fields=[]))
    return [reader.get_batch(n).num_rows for n in numbers]


class ArrowIpcReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], schema, split_bytes: int):
        self.files, self.names, self.split_bytes = files, schema.names, split_bytes
        self.fields = schema
        self.tests: list[tuple[str, type, object]] = []

    def __getstate__(self):
        """What every task is sent: partitions name their files themselves."""
        return {**self.__dict__, "files": []}

    def pushFilters(self, filters):
        """Filters on ``_file`` and ``_block`` spare what they exclude. Spark applies all filters to the rows that come."""
        for found in filters:
            name = found.attribute[0] if len(getattr(found, "attribute", ())) == 1 else None
            if name in ("_file", "_block") and type(found) in TESTS:
                self.tests.append((name, type(found), found.value))
            yield found

    def _wanted(self, name: str, value) -> bool:
        return all(TESTS[kind](value, other) for tested, kind, other in self.tests if tested == name)

    def _column(self, batch: pa.RecordBatch, name: str) -> pa.Array:
        wanted = self.fields[name].dataType
        if name not in batch.schema.names:
            return pa.nulls(batch.num_rows, to_arrow_schema(self.fields).field(name).type)
        column = batch.column(name)
        same = from_arrow_type(column.type) == wanted
        return column if same else column.cast(to_arrow_schema(self.fields).field(name).type)

    def partitions(self):
        ranges, sizes = [], []
        for uri, size in self.files:
            if not self._wanted("_file", uri):
                continue
            parts = max(1, -(-size // self.split_bytes))
            if parts == 1:
                ranges.append(BatchRange(uri, 0, None))
                sizes.append(size)
                continue
            n = _open(uri).num_record_batches
            step = max(1, -(-n // parts))
            ranges += [BatchRange(uri, at, min(at + step, n)) for at in range(0, n, step)]
            sizes += [size * step // n for _ in range(0, n, step)]
        return in_tasks(ranges, sizes) or [BatchRange("", 0, 0)]

    def read(self, partition: BatchRange):
        for one in (partition, *partition.after):
            if one.uri:
                yield from self._batches(one)

    def _batches(self, partition: BatchRange):
        reader = _open(partition.uri, self.names)
        last = reader.num_record_batches if partition.last is None else partition.last
        row = sum(_rows(partition.uri, range(partition.first))) if "_row" in self.names else 0
        for number in range(partition.first, last):
            if not self._wanted("_block", number):
                row += _rows(partition.uri, range(number, number + 1))[0] if "_row" in self.names else 0
                continue
            batch = reader.get_batch(number)
            n = batch.num_rows
            order = {
                "_file": pa.repeat(pa.scalar(partition.uri, pa.string()), n),
                "_block": pa.repeat(pa.scalar(number, pa.int64()), n),
                "_pos": pa.array(np.arange(n, dtype=np.int64)),
                "_row": pa.array(np.arange(row, row + n, dtype=np.int64)),
            }
            row += n
            columns = [order[c] if c in order else self._column(batch, c) for c in self.names]
            yield pa.RecordBatch.from_arrays(columns, names=self.names)


class ArrowIpcStreamReader(DataSourceStreamReader):
    """New files of a folder, in the order of their last change, then of their names.

    The offset is the change and the name of the last file taken. Files that changed within the last ``settle`` seconds
    wait, so that no file with an equal or an earlier time can follow one that was taken; a file that is moved in with an
    older time than that is not seen.
    """

    def __init__(self, paths: list[str], schema, split_bytes: int, settle: float):
        self.paths, self.settle = paths, settle
        self.reader = ArrowIpcReader([], schema, split_bytes)

    def _changes(self) -> list[tuple[int, str, int]]:
        found = []
        for uri, size in list_files(self.paths, SUFFIXES):
            system, path = locate(uri)
            found.append((system.get_file_info(path).mtime_ns, uri, size))
        return sorted(found)

    def initialOffset(self) -> dict:
        return {"changed": 0, "uri": ""}

    def latestOffset(self) -> dict:
        settled = [x for x in self._changes() if x[0] <= time.time_ns() - int(self.settle * 1e9)]
        return {"changed": settled[-1][0], "uri": settled[-1][1]} if settled else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        low, high = ((o["changed"], o["uri"]) for o in (start, end))
        self.reader.files = [(uri, size) for changed, uri, size in self._changes() if low < (changed, uri) <= high]
        return self.reader.partitions()

    def read(self, partition: BatchRange):
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        pass


class ArrowIpcSource(DataSource):
    @classmethod
    def name(cls):
        return "arrow_ipc"

    def _files(self):
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        files = list_files(paths, SUFFIXES)
        if not files:
            raise FileNotFoundError(f"no Arrow files in {paths}")
        return files

    def schema(self):
        uris, shards = [uri for uri, _ in self._files()], self.options.get("rows") == "true"
        with ThreadPoolExecutor(SCHEMA_READERS) as pool:  # shards have one schema, of other files every footer is read
            schemas = list(pool.map(lambda uri: _open(uri).schema.remove_metadata(), uris[:1] if shards else uris))
        found = pa.unify_schemas(schemas, promote_options="permissive")
        order = [*ORDER_FIELDS, ROW_FIELD] if shards else ORDER_FIELDS
        if "columns" in self.options:
            found = pa.schema([found.field(name) for name in json.loads(self.options["columns"])])
        return from_arrow_schema(pa.schema([*found, *[pa.field(n, t) for n, t in order]]))

    def streamReader(self, schema):
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return ArrowIpcStreamReader(
            paths, schema, int(self.options.get("split_bytes", 256 << 20)), float(self.options.get("settle_seconds", 2)))

    def reader(self, schema):
        files, split_bytes = self._files(), int(self.options.get("split_bytes", 256 << 20))
        self.options = {}  # the source goes to every task, the list of paths need not
        return ArrowIpcReader(files, schema, split_bytes)


def read_arrow(spark, *paths: str, schema=None, columns: list[str] | None = None, **options):
    """Records of Arrow IPC files with their order columns.

    With ``columns`` or a ``schema`` only these columns are read from the files; Spark cannot tell a Python source which
    ones a query needs. Filters on ``_file`` and ``_block`` are pushed down and spare files and record batches.
    """
    register_source(spark, ArrowIpcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    if columns is not None:
        options["columns"] = json.dumps(columns)
    reader = spark.read.format("arrow_ipc").option("paths", json.dumps(list(paths)))
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return (reader.schema(schema) if schema is not None else reader).load()
