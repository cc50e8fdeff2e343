"""Data source writer for files whose boundaries come from the data, not from the tasks.

Rows arrive grouped by a ``file_name`` column, which may name a folder (``dataset=…/``) before the file; every file is
written by one task into ``_staging`` and renamed at the commit of the job, many at a time. A lost task leaves nothing
behind but staging files, and a rerun gives the same files. Files of an earlier run go before the first rename, so a
commit that is cut off leaves a folder without its manifest, never one with shards of two runs.
Formats: ``arrow`` (training rows in record batches of at most ``BATCH_ROWS`` rows) and ``flat`` (unsigned 32-bit ids).
"""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from blockloom.operators.tokenize import list_tokens
from blockloom.session import passing_shuffles, small_batches
from blockloom.sources.storage import locate, register_source

BATCH_ROWS = 4096
COMMIT_THREADS = 32
ROW_SCHEMA = pa.schema([
    pa.field("input_ids", pa.list_(pa.int32())), pa.field("labels", pa.list_(pa.int32())), pa.field("length", pa.int32()),
])


@dataclass
class Written(WriterCommitMessage):
    files: list


class _ArrowFile:
    def __init__(self, stream, compression: str):
        codec = None if compression == "none" else compression
        self.stream = stream
        self.writer = pa.ipc.new_file(stream, ROW_SCHEMA, options=pa.ipc.IpcWriteOptions(compression=codec))

    def add(self, batch: pa.RecordBatch):
        table = pa.Table.from_batches([batch.select(ROW_SCHEMA.names)]).cast(ROW_SCHEMA)
        self.writer.write_table(table, max_chunksize=BATCH_ROWS)

    def close(self):
        self.writer.close()
        self.stream.close()


class _FlatFile:
    def __init__(self, stream, compression: str):
        self.stream = stream

    def add(self, batch: pa.RecordBatch):
        widths, data = batch.column("width").to_numpy(), batch.column("data")
        data = data.cast(pa.large_binary())
        offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1]
        edges = [0, *(np.flatnonzero(np.diff(widths)) + 1), len(widths)]
        for a, b in zip(edges, edges[1:]):  # rows of one width lie one after the other
            ids = np.frombuffer(data.buffers()[2][offsets[a]:offsets[b]], f"<u{widths[a]}")
            self.stream.write(ids.astype("<u4").tobytes())

    def close(self):
        self.stream.close()


KINDS = {"arrow": _ArrowFile, "flat": _FlatFile}

# How the files of a kind are named; only such files are replaced.
NAMES = {"arrow": r"(train|val)_shard_\d{5,}\.arrow", "flat": r"part-\d{10,}\.bin"}


class TokenFileWriter(DataSourceArrowWriter):
    def __init__(self, directory: str, kind: str, compression: str, overwrite: bool, folders: str = ""):
        self.directory, self.kind, self.compression = directory.rstrip("/"), kind, compression
        self.overwrite, self.folders = overwrite, folders
        self.staging = f"{self.directory}/_staging-{uuid.uuid4().hex}"

    def write(self, batches):
        system, staging = locate(self.staging)
        system.create_dir(staging, recursive=True)
        attempt, written, current, name = uuid.uuid4().hex, [], None, None
        for batch in batches:
            names = batch.column("file_name").to_pylist()
            at = 0
            while at < len(names):
                end = at + 1
                while end < len(names) and names[end] == names[at]:
                    end += 1
                if names[at] != name:
                    if current:
                        current.close()
                    name = names[at]
                    staged = f"{staging}/{attempt}-{len(written)}"
                    current = KINDS[self.kind](system.open_output_stream(staged), self.compression)
                    written.append((staged, name))
                current.add(batch.slice(at, end - at))
                at = end
        if current:
            current.close()
        return Written(written)

    def commit(self, messages):
        system, target = locate(self.directory)
        system.create_dir(target, recursive=True)
        moves = [(staged, f"{target}/{name}") for message in messages if message for staged, name in message.files]
        folders = {new.rpartition("/")[0] for _, new in moves}
        with ThreadPoolExecutor(COMMIT_THREADS) as pool:
            if self.overwrite:
                list(pool.map(system.delete_file, self._earlier(system, target)))
            list(pool.map(lambda folder: system.create_dir(folder, recursive=True), folders - {target}))
            list(pool.map(lambda move: system.move(*move), moves))
        self._clean()

    def _earlier(self, system, target: str) -> list[str]:
        """Files of an earlier run: of this kind, in the folder itself or in one of those that ``folders`` names."""
        found = system.get_file_info(fs.FileSelector(target))
        inside = [
            info for folder in found if self.folders and folder.type == fs.FileType.Directory
            and folder.base_name.startswith(f"{self.folders}=") for info in system.get_file_info(fs.FileSelector(folder.path))]
        return [i.path for i in ([] if self.folders else found) + inside
                if i.type == fs.FileType.File and re.fullmatch(NAMES[self.kind], i.base_name)]

    def abort(self, messages):
        self._clean()

    def _clean(self):
        system, staging = locate(self.staging)
        system.create_dir(staging, recursive=True)
        system.delete_dir(staging)


class TokenFileSink(DataSource):
    @classmethod
    def name(cls):
        return "token_files"

    def schema(self):
        return "file_name STRING"

    def writer(self, schema, overwrite):
        return TokenFileWriter(self.options["path"], self.options["kind"], self.options.get("compression", "none"), overwrite,
            self.options.get("folders", ""))


def write_token_files(df: DataFrame, path: str, kind: str, compression: str = "none", folders: str = "") -> None:
    """Write rows, already grouped by ``file_name`` inside their partitions; files of an earlier run are replaced.

    With ``folders``, the name of a column such as ``dataset``, the files lie in folders ``dataset=…``.
    """
    register_source(df.sparkSession, TokenFileSink)
    with passing_shuffles(df.sparkSession):
        (
            df.write.format("token_files").mode("overwrite")
            .option("path", path).option("kind", kind).option("compression", compression).option("folders", folders).save()
        )


@F.arrow_udf(T.StructType([T.StructField("width", T.ByteType()), T.StructField("data", T.BinaryType())]))
def _packed(ids: pa.Array) -> pa.Array:
    """Each list of ids as bytes, in the fewest of 1, 2 or 4 bytes per id that hold all of the batch."""
    offsets, values = list_tokens(ids)
    values = values.view(np.uint32)
    most = int(values.max()) if values.size else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    data = pa.Array.from_buffers(pa.large_binary(), len(ids), [
        None, pa.py_buffer(offsets.astype(np.int64) * width), pa.py_buffer(values.astype(f"<u{width}"))]).cast(pa.binary())
    return pa.StructArray.from_arrays([pa.array(np.full(len(ids), width, np.int8)), data], names=["width", "data"])


def write_flat_tokens(
    placed: DataFrame, path: str, tokens_per_file: int = 64 << 20, start: str = "start", ids: str = "ids"
) -> None:
    """Write a token stream ``(start, ids)`` as ``part-N.bin``; the files in name order are the stream.

    The file follows from the place in the stream, so no sampling pass and no global sort is needed. Ids move to their
    file in as few bytes as hold them: those of bytes take one each, a quarter of what the file takes.
    """
    small_batches(placed.sparkSession)
    part = F.expr(f"{start} div {int(tokens_per_file)}")
    rows = placed.where(F.size(ids) > 0).select(part.alias("part"), F.col(start).alias("start"), _packed(F.col(ids)).alias("ids"))
    rows = rows.repartition("part").sortWithinPartitions("part", "start")
    name = F.concat(F.lit("part-"), F.lpad(F.col("part").cast("string"), 10, "0"), F.lit(".bin"))
    write_token_files(rows.select(name.alias("file_name"), "ids.width", "ids.data"), path, "flat")
