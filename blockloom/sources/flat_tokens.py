"""Flat token files (unsigned 32-bit integers without header) as a data source, ``flat_tokens``.

The files of a directory, in name order, are one stream. Each row is a run of it: ``(start, n, ids)``, the form
``cut_stream`` takes, so windows of any width may cross runs and files.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from blockloom.sources.storage import in_tasks, list_files, locate, register_source

TOKEN_BYTES = 4


#: Runs of a file that a reader may be asked for.
ALL, WHOLE, EDGES = "all", "whole", "edges"


def token_files(paths: list[str]) -> list[tuple[str, int]]:
    """``(uri, size)`` of the files of a stream, in order."""
    files = list_files(paths, (".bin",))
    if not files:
        raise FileNotFoundError(f"no token files in {paths}")
    for uri, size in files:
        if size % TOKEN_BYTES:
            raise ValueError(f"{uri}: {size} bytes are no whole number of tokens")
    return files


class ByteRange(InputPartition):
    def __init__(self, uri: str, offset: int, n_tokens: int, start: int):
        self.uri, self.offset, self.n_tokens, self.start = uri, offset, n_tokens, start
        self.after: list[ByteRange] = []  # ranges that the same task reads next


class FlatTokenReader(DataSourceReader):
    """Runs end at multiples of ``run`` in the stream, and at the ends of files.

    ``only`` leaves out the runs that a file's border cuts (``whole``), or all others (``edges``).
    """

    def __init__(self, files: list[tuple[str, int]], run: int, split_bytes: int, only: str = ALL):
        if only not in (ALL, WHOLE, EDGES):
            raise ValueError(f"unknown runs {only!r}")
        self.files, self.run, self.only = files, run, only
        self.split = max(run, split_bytes // TOKEN_BYTES // run * run)

    def __getstate__(self):
        """What every task is sent: partitions name their files themselves."""
        return {**self.__dict__, "files": []}

    def partitions(self):
        ranges, start = [], 0
        for uri, size in self.files:
            end = start + size // TOKEN_BYTES
            # The first and the last run of a file are whole if they begin and end at a multiple.
            low, high = min(end, -(-start // self.run) * self.run), max(start, end // self.run * self.run)
            if low > high:
                low = high = end
            edges = [(start, low), (high, end)]
            inner = [(at, min(high, at + self.split)) for at in range(low, high, self.split)]
            for a, b in (edges if self.only != WHOLE else []) + (inner if self.only != EDGES else []):
                if a < b:
                    ranges.append(ByteRange(uri, (a - start) * TOKEN_BYTES, b - a, a))
            start = end
        return in_tasks(ranges, [r.n_tokens * TOKEN_BYTES for r in ranges]) or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange):
        for one in (partition, *partition.after):
            if one.n_tokens:
                yield from self._runs(one)

    def _runs(self, partition: ByteRange):
        system, path = locate(partition.uri)
        rows_per_batch = max(1, (4 << 20) // self.run)
        with system.open_input_file(path) as source:
            done = 0
            while done < partition.n_tokens:
                n = min(rows_per_batch * self.run, partition.n_tokens - done)
                data = source.read_at(n * TOKEN_BYTES, partition.offset + done * TOKEN_BYTES)
                ids = np.frombuffer(data, dtype="<u4")
                if ids.max() > np.iinfo(np.int32).max:
                    raise ValueError(f"{partition.uri}: token id above the signed 32-bit range")
                edges = np.append(np.arange(0, n, self.run), n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(edges[:-1] + partition.start + done, pa.int64()),
                        pa.array(np.diff(edges), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int32))),
                    ],
                    names=["start", "n", "ids"],
                )
                done += n


class FlatTokenSource(DataSource):
    @classmethod
    def name(cls):
        return "flat_tokens"

    def schema(self):
        return "start BIGINT, n BIGINT, ids ARRAY<INT>"

    def reader(self, schema):
        options, self.options = self.options, {}  # the source goes to every task, the list of paths need not
        files = token_files(json.loads(options["paths"]))
        return FlatTokenReader(files, int(options["run"]), int(options.get("split_bytes", 128 << 20)), options.get("only", ALL))


def read_flat_tokens(spark: SparkSession, *paths: str, run: int = 1024, **options) -> DataFrame:
    """The token stream of flat files in runs of ``run`` tokens: ``(start, n, ids)``."""
    register_source(spark, FlatTokenSource)
    reader = spark.read.format("flat_tokens").option("paths", json.dumps(list(paths))).option("run", str(run))
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load()


def read_runs(spark: SparkSession, *paths: str, run: int = 1024, **options) -> DataFrame:
    """The stream of flat files in runs of ``run`` tokens: ``(block_id, tokens)``; the last one may be short.

    Whole runs come as they are read. Only the runs that a file's border cuts, two per file, meet in a shuffle.
    """
    number = F.expr(f"start div {int(run)}").alias("block_id")
    whole = read_flat_tokens(spark, *paths, run=run, only=WHOLE, **options).select(number, F.col("ids").alias("tokens"))
    cut = read_flat_tokens(spark, *paths, run=run, only=EDGES, **options).groupBy(number).agg(
        F.sort_array(F.collect_list(F.struct("start", "ids"))).alias("_parts"))
    return whole.unionByName(cut.select("block_id", F.flatten(F.col("_parts.ids")).alias("tokens")))
