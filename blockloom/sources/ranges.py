"""Files whose records have no fixed end, read as byte ranges: JSON arrays, and CSV with line ends inside quotes.

A range of a file cannot tell where it begins: inside a string or not, how deep in an array. Its effect on either state
can be told without knowing it. So each file is read twice, by tasks of one range each:

1. every range gives its effect, and running totals over a file's ranges, one row per range, give each its first state;
2. every range cuts the records that begin in it and reads on behind its end until the last one is whole.

No task sees more than its range and what its last record takes, whatever the size of the file. Bytes are searched with
array operations, some megabytes at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.sources.storage import locate

CHUNK = 1 << 22
OUTPUT_BYTES = 1 << 22
SPLIT_BYTES = 1 << 26
#: Bytes read at once to follow a run of quotes or backslashes.
RUN = 1 << 12
RECORDS = "_file STRING, _block BIGINT, _pos BIGINT, record BINARY"


class Bytes:
    """A file's bytes by place; nothing is kept."""

    def __init__(self, path: str):
        system, inside = locate(path)
        self.file = system.open_input_file(inside)
        self.size = self.file.size()

    def __call__(self, start: int, end: int) -> np.ndarray:
        start, end = max(0, start), min(self.size, end)
        if start >= end:
            return np.zeros(0, np.uint8)
        self.file.seek(start)
        return np.frombuffer(self.file.read(end - start), np.uint8)


def file_ranges(spark: SparkSession, paths: list[str], split_bytes: int) -> tuple[DataFrame, int]:
    """``path, file, start, end``: the ranges of all files; ``file`` is the name that orders files. And how many tasks they take.

    A task takes some ``split_bytes``: one whole range, or many small files, so tasks follow the bytes and not the files.
    """
    files = spark.read.format("binaryFile").load(paths).where("length > 0").select(
        "path", F.col("_metadata.file_path").alias("file"), "length")
    last = F.expr(f"(length - 1) div {split_bytes}")
    ranges = files.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_n")).select(
        "path", "file", (F.col("_n") * split_bytes).alias("start"), F.least("length", (F.col("_n") + 1) * split_bytes).alias("end"))
    found = ranges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("size")).first()
    tasks = max(1, min(found["n"], max(-(-(found["size"] or 0) // split_bytes), spark.sparkContext.defaultParallelism)))
    return ranges.repartition(tasks), tasks


def _effects(ranges: DataFrame, effect: Callable[[Bytes, int, int], dict], schema: str) -> DataFrame:
    """The ranges with the columns of ``effect``."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [effect(Bytes(r["path"]), r["start"], r["end"]) for r in rows]
            if rows:
                yield pa.RecordBatch.from_pylist([r | f for r, f in zip(rows, found)])

    return ranges.mapInArrow(each, f"path STRING, file STRING, start BIGINT, end BIGINT, {schema}")


def _cut(ranges: DataFrame, tasks: int, records: Callable[[Bytes, dict], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """``_file, _block, _pos, record``: the records that begin in each range, by their place in the file."""
    def batch_of(row: dict, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        n = len(held)
        return pa.RecordBatch.from_arrays([
            pa.array([row["file"]] * n, pa.string()), pa.array([0] * n, pa.int64()),
            pa.array([at for at, _ in held], pa.int64()), pa.array([r for _, r in held], pa.binary())],
            ["_file", "_block", "_pos", "record"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held, size = [], 0
                for at, record in records(Bytes(row["path"]), row):
                    held.append((at, record))
                    size += len(record)
                    if size >= OUTPUT_BYTES:
                        yield batch_of(row, held)
                        held, size = [], 0
                if held:
                    yield batch_of(row, held)

    # Records are known by their byte, so all of a file is one block.
    return ranges.repartition(tasks, "path", "start").mapInArrow(each, RECORDS)


def _in_order(path: str = "path") -> Window:
    return Window.partitionBy(path).orderBy("start")


# ---------------------------------------------------------------- CSV

QUOTE, FEED, RETURN = 34, 10, 13


def _quote_runs(read: Bytes, start: int, end: int, delimiter: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of quotes that begin in ``start .. end``: their ends, whether they swap the state, whether they close.

    A run of an odd number of quotes swaps the state at the start of a field, and closes a quoted field anywhere else;
    an even number changes nothing. Quotes inside an unquoted field are text.
    """
    base = start - max(0, start - len(delimiter))
    data = read(start - base, end)
    at = np.flatnonzero(data == QUOTE)
    firsts = at[(at == 0) | (data[at - 1] != QUOTE)]
    firsts = firsts[firsts >= base]
    size = np.diff(np.append(np.searchsorted(at, firsts), at.size))
    if firsts.size and firsts[-1] + size[-1] == data.size:  # the last run may go on behind the end
        reach, more = end, read(end, end + RUN)
        while more.size:
            other = np.flatnonzero(more != QUOTE)
            size[-1] += int(other[0]) if other.size else more.size
            reach += more.size
            more = read(reach, 0 if other.size else reach + RUN)
    before = firsts - 1
    opens = (firsts + start - base == 0) | np.isin(data[before], [FEED, RETURN])
    named = np.ones(firsts.size, bool)
    for i, byte in enumerate(reversed(delimiter)):
        place = firsts - 1 - i
        named &= (place >= 0) & (data[np.maximum(place, 0)] == byte)
    opens |= named
    odd = size % 2 == 1
    return firsts + (start - base) + size, odd & opens, odd & ~opens


def _quoted(swaps: np.ndarray, closes: np.ndarray, quoted: bool) -> np.ndarray:
    """The state behind each run."""
    total = np.cumsum(swaps)
    last = np.maximum.accumulate(np.where(closes, np.arange(closes.size), -1)) if closes.size else closes
    return np.where(last >= 0, total - total[np.maximum(last, 0)], total + quoted) % 2 == 1 if closes.size else closes


def _csv_effect(delimiter: bytes) -> Callable[[Bytes, int, int], dict]:
    def effect(read: Bytes, start: int, end: int) -> dict:
        closed, odd = False, 0
        for at in range(start, end, CHUNK):
            _, swaps, closes = _quote_runs(read, at, min(end, at + CHUNK), delimiter)
            held = np.flatnonzero(closes)
            if held.size:
                closed, odd = True, 0
                swaps = swaps[held[-1] + 1:]
            odd = (odd + int(swaps.sum())) % 2
        return {"closed": int(closed), "odd": odd}

    return effect


def _csv_records(delimiter: bytes) -> Callable[[Bytes, dict], Iterator[tuple[int, bytes]]]:
    def records(read: Bytes, row: dict) -> Iterator[tuple[int, bytes]]:
        at, end, quoted = row["start"], row["end"], bool(row["quoted"])
        edge = read(at - 1, at + 1)
        begin = 0 if at == 0 else None
        if at and not quoted and (edge[0] == FEED or edge[0] == RETURN and not (edge.size > 1 and edge[1] == FEED)):
            begin = at
        pending: list[bytes] = []
        while at < read.size and (at < end or begin is not None and begin < end):
            stop = min(read.size, at + CHUNK) if at >= end else min(end, at + CHUNK)
            data = read(at, stop + 1)
            ends, swaps, closes = _quote_runs(read, at, stop, delimiter)
            states = np.concatenate([[quoted], _quoted(swaps, closes, quoted)])
            body = data[:stop - at]
            line = np.flatnonzero((body == FEED) | (body == RETURN))
            if line.size:
                follows = data[np.minimum(line + 1, data.size - 1)] == FEED
                line = line[~((body[line] == RETURN) & follows & (line + 1 < data.size))]
                line = line[~states[np.searchsorted(ends, line + at, "right")]]
            raw, done = body.tobytes(), 0
            for cut in (line + 1).tolist():
                if begin is not None:
                    if begin >= end:
                        return
                    yield begin, b"".join([*pending, raw[done:cut]])
                pending, done, begin = [], cut, at + cut
            if begin is not None and begin < end:
                pending.append(raw[done:])
            quoted, at = bool(states[-1]), stop
        if begin is not None and begin < end and any(pending):
            yield begin, b"".join(pending)

    return records


def csv_records(spark: SparkSession, paths: list[str], delimiter: str, split_bytes: int) -> DataFrame:
    """``_file, _block, _pos, record``: the records of CSV files, with their line ends; ``_pos`` is the first byte."""
    named = delimiter.encode()
    ranges, tasks = file_ranges(spark, paths, split_bytes)
    ranges = _effects(ranges, _csv_effect(named), "closed BIGINT, odd BIGINT")
    ranges = ranges.withColumn("_closed", F.sum("closed").over(_in_order()))
    behind = F.sum("odd").over(Window.partitionBy("path", "_closed").orderBy("start")) % 2
    ranges = ranges.withColumn("_behind", behind)
    ranges = ranges.withColumn("quoted", F.coalesce(F.lag("_behind").over(_in_order()), F.lit(0)))
    return _cut(ranges.select("path", "file", "start", "end", "quoted"), tasks, _csv_records(named))


# ---------------------------------------------------------------- JSON arrays

BACKSLASH = 92
OPEN, CLOSE = (91, 123), (93, 125)


def _marks(read: Bytes, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the quotes that are not escaped, of brackets and braces wherever they stand, and their bytes."""
    data = read(start, end)
    slashes = np.flatnonzero(data == BACKSLASH)
    quotes = np.flatnonzero(data == QUOTE)
    # The length of the run of backslashes that ends before each quote; a run may begin before the range.
    first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
    run = np.arange(slashes.size) - np.repeat(first, np.diff(np.append(first, slashes.size))) + 1
    if slashes.size and slashes[0] == 0 or quotes.size and quotes[0] == 0:
        carried, at = 0, start
        while at > 0:
            before = read(at - RUN, at)
            other = np.flatnonzero(before != BACKSLASH)
            carried += before.size - 1 - int(other[-1]) if other.size else before.size
            at -= before.size
            if other.size:
                break
        if slashes.size and slashes[0] == 0:
            n = first[1] if first.size > 1 else slashes.size
            run[:n] += carried
        elif carried % 2:
            quotes = quotes[1:]
    place = np.searchsorted(slashes, quotes) - 1
    behind = (place >= 0) & (slashes[np.maximum(place, 0)] == quotes - 1) if slashes.size else np.zeros(quotes.size, bool)
    escaped = behind & (run[np.maximum(place, 0)] % 2 == 1) if slashes.size else behind
    quotes = quotes[~escaped]
    marks = np.flatnonzero((data == 91) | (data == 93) | (data == 123) | (data == 125))
    return quotes + start, marks + start, data[marks]


def _steps(marks: np.ndarray) -> np.ndarray:
    return np.where(np.isin(marks, OPEN), 1, -1)


def _json_effect(read: Bytes, start: int, end: int) -> dict:
    """Whether the range holds an odd number of quotes, and how it changes the depth from outside and inside a string."""
    odd, depth = 0, [0, 0]
    for at in range(start, end, CHUNK):
        quotes, places, marks = _marks(read, at, min(end, at + CHUNK))
        inside = (np.searchsorted(quotes, places) + odd) % 2
        steps = _steps(marks)
        depth = [depth[s] + int(steps[inside == s].sum()) for s in (0, 1)]
        odd = (odd + quotes.size) % 2
    return {"odd": odd, "outer": depth[0], "inner": depth[1]}


class _Between:
    """Checks what stands between the objects of an array: other items and commas, brackets at the ends."""

    def __init__(self) -> None:
        self.known: set[bytes] = set()

    def __call__(self, gap: bytes, first: bool, last: bool) -> None:
        text = (b"" if first else b"[0") + gap.strip() + (b"" if last else b"0]")
        if text not in self.known:
            json.loads(text.decode("utf-8", "replace"))
            if len(text) < 64 and len(self.known) < 10_000:
                self.known.add(text)


def _json_records(read: Bytes, row: dict) -> Iterator[tuple[int, bytes]]:
    """The objects that are items of the array; what follows each until the next is checked."""
    at, end = row["start"], row["end"]
    quoted, depth = row["quoted"], row["depth"]
    check = _Between()
    # ``item`` is where the open object began, ``gap`` where the last one ended; a range knows neither at first.
    item, gap, first = None, 0 if at == 0 else None, at == 0
    pending: list[bytes] = []
    while at < read.size and (at < end or item is not None or gap is not None):
        stop = min(read.size, at + CHUNK)
        if at < end:
            stop = min(stop, end)
        raw = read(at, stop).tobytes()
        quotes, places, marks = _marks(read, at, stop)
        outside = (np.searchsorted(quotes, places) + quoted) % 2 == 0
        places, marks = places[outside], marks[outside]
        steps = _steps(marks)
        depths = depth + np.cumsum(steps)
        begins = (marks == 123) & (depths == 2) & (steps == 1)
        ends = (marks == 125) & (depths == 1) & (steps == -1)
        done = at
        for place, begin in zip(places[begins | ends].tolist(), begins[begins | ends].tolist()):
            if begin:
                if gap is not None:
                    check(b"".join([*pending, raw[done - at:place - at]]), first, False)
                pending, gap, done = [], None, place
                if place >= end:
                    return
                if item is not None:
                    raise ValueError(f"{row['path']}: brackets do not match in the object at byte {item}")
                item, first = place, False
            elif item is not None:
                yield item, b"".join([*pending, raw[done - at:place + 1 - at]])
                pending, item, gap, done = [], None, place + 1, place + 1
        if item is not None or gap is not None:
            pending.append(raw[done - at:])
        quoted, depth, at = (quoted + quotes.size) % 2, int(depths[-1]) if depths.size else depth, stop
    if item is not None:
        raise ValueError(f"{row['path']}: the array ends inside the object at byte {item}")
    if gap is not None:
        check(b"".join(pending), first, True)


def array_records(spark: SparkSession, paths: list[str], split_bytes: int) -> DataFrame:
    """``_file, _block, _pos, record``: the objects of files that hold one JSON array; a broken array fails the job."""
    ranges, tasks = file_ranges(spark, paths, split_bytes)
    ranges = _effects(ranges, _json_effect, "odd BIGINT, outer BIGINT, inner BIGINT")
    earlier = _in_order().rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("quoted", F.coalesce(F.sum("odd").over(earlier) % 2, F.lit(0)))
    ranges = ranges.withColumn("_change", F.when(F.col("quoted") == 1, F.col("inner")).otherwise(F.col("outer")))
    ranges = ranges.withColumn("depth", F.coalesce(F.sum("_change").over(earlier), F.lit(0)))
    return _cut(ranges.select("path", "file", "start", "end", "quoted", "depth"), tasks, _json_records)
