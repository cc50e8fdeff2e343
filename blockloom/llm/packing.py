"""Packing documents into sequences of a fixed length at a balanced cost of attention.

A document's ids with the end id are cut into pieces of ``LENGTH``; a whole piece is a sequence of its own. The shorter
last pieces are dealt by a hash of their place into cells of about ``CELL_TOKENS`` ids, whatever their number. A cell
opens as many sequences as its ids need and takes its pieces in descending size. Each goes to the sequence of the lowest
estimated cost, ``n * (LINEAR + n)`` for a piece of ``n`` ids: the linear and the quadratic part of a layer; among those
with room for it. A piece that fits nowhere whole is cut: the sequence with the most room takes what it can hold, and
the rest is a piece again. So a cell leaves less than one sequence of padding, 0.2 % on average. Sequences are numbered
without gaps, whole pieces first.

Defined results: a null text counts as empty and has only the end id; rows of one or of no ``doc_id`` are documents of
their own; other columns of the documents are not read, whatever their names; an empty table gives no pieces. A very
long text is encoded in slices, but its ids, and no more than one such text, are held by one task; only its last piece
moves. Numbers of sequences follow the rows' places in the input files, so a rerun over the same files agrees.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import text_of
from blockloom.llm.encoding import encoder, text_slices, with_ends
from blockloom.operators.order import with_start
from blockloom.session import materialize

LENGTH = 1024
END_ID = 0
CELL_TOKENS = 1 << 18
#: The linear part of the cost in ids: six times the width of a layer of 768.
LINEAR = 4608

PIECES = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary, part int, no long"
PLACED = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids array<int>, cell long, sequence long, offset long"


def _width(tokenizer: str) -> int:
    """Bytes of an id in the written tables."""
    return 2 if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else 4


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The written table of the documents' pieces of at most ``length`` ids.

    ``part`` is the writing task, ``no`` numbers its whole and its shorter pieces, each from 0.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = encoder(tokenizer).encode, _width(tokenizer)
        part = TaskContext.get().partitionId()
        numbered = [0, 0]
        for batch in batches:
            done = 0
            for texts in text_slices(batch.column(1)):
                stream, upto = with_ends(*encode(texts), end_id)
                totals = np.diff(upto)
                counts = -(-totals // length)
                owner = np.repeat(np.arange(len(texts)), counts)
                start = (np.arange(owner.size) - np.repeat(np.cumsum(counts) - counts, counts)) * length
                size = np.minimum(length, totals[owner] - start)
                borders = np.append(upto[owner] + start, stream.size)
                raw = memoryview(stream).cast("B")
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(borders.tolist(), borders[1:].tolist())]
                number = np.empty(owner.size, np.int64)
                for kind, held in enumerate((size == length, size < length)):
                    number[held] = numbered[kind] + np.arange(held.sum())
                    numbered[kind] += int(held.sum())
                packed = stream.astype(f"<u{width}")
                ids = pa.Array.from_buffers(pa.large_binary(), owner.size, [None, pa.py_buffer(borders * width), pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(done, len(texts)).take(pa.array(owner)), pa.array(start), pa.array(size),
                    pa.array(totals[owner]), pa.array(crc, pa.int64()), ids.cast(pa.binary()),
                    pa.array(np.full(owner.size, part, np.int32)), pa.array(number)],
                    ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids", "part", "no"])
                done += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    return materialize(rows.mapInArrow(each, PIECES), "packing-pieces")


def cost(n: np.ndarray | int) -> np.ndarray | int:
    """The estimated cost of attention over a piece of ``n`` ids, in units of one id's linear cost over ``LINEAR``."""
    return n * (LINEAR + n)


def assign(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """``piece, from, size, sequence, offset`` of each part that is placed; pieces of equal size go by their place."""
    n_sequences = -(-int(sizes.sum()) // length)
    used, costs = np.zeros(n_sequences, np.int64), np.zeros(n_sequences, np.int64)
    waiting = [(-n, i, 0) for i, n in enumerate(sizes.tolist())]
    heapq.heapify(waiting)
    placed = []
    while waiting:
        n, piece, begin = heapq.heappop(waiting)
        n = -n
        open_ = np.flatnonzero(used <= length - n)
        if open_.size:
            to, size = int(open_[np.argmin(costs[open_])]), n
        else:
            to = int(np.argmin(used))
            size = length - int(used[to])
            heapq.heappush(waiting, (size - n, piece, begin + size))
        placed.append((piece, begin, size, to, int(used[to])))
        used[to] += size
        costs[to] += cost(size)
    return tuple(np.array(placed, np.int64).reshape(-1, 5).T)


def packed(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, cell_tokens: int = CELL_TOKENS,
    with_ids: bool = True,
) -> DataFrame:
    """Per placed piece: ``doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset`` and its ``ids``."""
    cut = pieces(docs, tokenizer, length, end_id)
    whole, rest = cut.where(F.col("length") == length), cut.where(F.col("length") < length)
    n_rest = rest.agg(F.sum("length").alias("n")).first()["n"] or 0
    cell = F.pmod(F.xxhash64("part", "no"), F.lit(max(1, -(-n_rest // cell_tokens))).cast("long"))
    rest = rest.withColumn("cell", cell)

    def place(table: pa.Table) -> pa.Table:
        width = _width(tokenizer)
        # The order within a cell is that of the pieces' places, however the rows arrive.
        table = table.combine_chunks().sort_by([("part", "ascending"), ("no", "ascending")])
        piece, begin, size, sequence, offset = assign(table["length"].to_numpy(), length)
        held = [np.frombuffer(x.as_py(), f"<u{width}") for x in table["ids"]]
        ids = [held[p][b:b + n].astype("<u4") for p, b, n in zip(piece, begin, size)]
        taken = table.select(["doc_id", "doc_tokens", "cell"]).take(pa.array(piece))
        arrays = [
            taken["doc_id"], pa.array(table["start"].to_numpy()[piece] + begin), pa.array(size), taken["doc_tokens"],
            pa.array([zlib.crc32(x) for x in ids], pa.int64()),
            pa.array([x.view(np.int32) for x in ids] if with_ids else [None] * len(ids), pa.list_(pa.int32())),
            taken["cell"], pa.array(sequence), pa.array(offset)]
        return pa.table(arrays, names=["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids", "cell", "sequence", "offset"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _width(tokenizer)
        for batch in batches:
            ids = [np.frombuffer(x.as_py(), f"<u{width}").astype(np.int32) for x in batch.column("ids")]
            at = batch.schema.get_field_index("ids")
            yield batch.set_column(at, "ids", pa.array(ids, pa.list_(pa.int32())))

    parts = with_start(whole.groupBy("part").agg(F.count("*").alias("_n")), "_n", (), "part")
    n_whole = whole.count()
    cells = rest.groupBy("cell").agg(F.ceil(F.sum("length") / length).alias("_n"))
    cells = with_start(cells, "_n", (), "cell").select("cell", F.col("start").alias("_base"))
    short = rest.groupBy("cell").applyInArrow(place, PLACED).join(cells, "cell").withColumn(
        "sequence_id", F.col("_base") + F.col("sequence") + n_whole)
    full = whole.join(parts.select("part", F.col("start").alias("_base")), "part").withColumns({
        "sequence_id": F.col("_base") + F.col("no"), "offset": F.lit(0).cast("long")})
    names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "offset"]
    if not with_ids:
        return full.select(*names).unionByName(short.select(*names))
    full = full.select(*names, "ids")
    schema = ", ".join(f"{n} long" for n in names) + ", ids array<int>"
    return full.mapInArrow(unpacked, schema).unionByName(short.select(*names, "ids"))


def sequences(placed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """Per sequence: ``sequence_id, input_ids, n_ids, parts``.

    Sequences are padded to ``length`` unless their number of ids is a power of two. ``parts`` has the documents and
    the lengths of their pieces in order, for an attention that stays within documents.
    """
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    ids = F.flatten(F.transform("_held", lambda x: x["ids"]))
    padding = F.when(F.bit_count(F.col("n_ids")) == 1, 0).otherwise(F.lit(length) - F.col("n_ids"))
    return (
        placed.groupBy("sequence_id").agg(held.alias("_held"))
        .withColumn("_ids", ids).withColumn("n_ids", F.size("_ids"))
        .select("sequence_id", F.concat("_ids", F.array_repeat(F.lit(pad_id), padding.cast("int"))).alias("input_ids"), "n_ids",
                F.transform("_held", lambda x: F.struct(x["doc_id"], x["start"], x["length"])).alias("parts"))
    )
