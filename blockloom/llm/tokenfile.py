"""Token ids as a Huffman-coded binary corpus.

The ids of all documents in ``doc_id`` order form one stream, cut into segments of whole documents. Code lengths
come from the counts over all documents, limited to ``MAX_BITS`` by package-merge, and codes are canonical, so the
lengths alone define them. A segment is one bit string; the bit offset of every ``BLOCK``-th id is a checkpoint, so
blocks decode independently: all blocks of a segment advance together, one table look-up per id.

The folder holds ``codes`` (id, length) and ``segments`` (first_doc, doc_ids, counts, n_ids, checkpoints, payload),
both as Parquet, written through Spark's commit, so a retried task leaves no half file.

Defined results: a null text counts as empty and has only the end id; rows of one ``doc_id`` follow the order of their
ids' checksum; null ids come first; the string of an added
token in a text is that token, as the tokenizer has it; an empty table gives an empty corpus.
Other columns are not read, whatever their names; a very long text is encoded in slices, and its ids are held by one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.llm.common import stream_starts, text_of
from blockloom.llm.encoding import ENCODED_BYTES, encoder, text_slices, with_ends
from blockloom.session import fresh_path, materialize, small_batches

END_ID = 0
MAX_BITS = 20
BLOCK = 256
SEGMENT_IDS = 1 << 20


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """The written table ``doc_id, n, crc, ids``: the ids of each document with the end id, 2 or 4 bytes each."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            done = 0
            for part in text_slices(batch.column(1), ENCODED_BYTES):
                ids, counts = encode(part)
                stream, upto = with_ends(ids, counts, end_id)
                raw = memoryview(stream).cast("B")
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(done, len(part)), pa.array(counts + 1),
                    pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(upto, upto[1:])], pa.int64()),
                    pa.array([_packed(stream[a:b]) for a, b in zip(upto, upto[1:])], pa.binary()),
                ], ["doc_id", "n", "crc", "ids"])
                done += len(part)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    return materialize(rows.mapInArrow(each, "doc_id long, n long, crc long, ids binary"), "token-ids")


def _packed(ids: np.ndarray) -> bytes:
    """A width byte, then the ids in that many bytes each."""
    small = ids.size and ids.max() < 1 << 16
    return (b"\x02" + ids.astype("<u2").tobytes()) if small else b"\x04" + ids.astype("<u4").tobytes()


def _unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if ids[0] == 2 else "<u4", offset=1)


def id_counts(tokens: DataFrame) -> DataFrame:
    """``id, count`` over all documents. A task sends a row per id it saw, at most the vocabulary."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                found = np.bincount(_unpacked(ids.as_py()))
                if found.size > total.size:
                    total = np.pad(total, (0, found.size - total.size))
                total[:found.size] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "count"])

    return tokens.select("ids").mapInArrow(each, "id int, count long").groupBy("id").agg(F.sum("count").alias("count"))


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge); counts are positive."""
    n = counts.size
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    levels, weights = [], leaves
    for _ in range(limit - 1):
        packages = weights[:weights.size // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, packages])
        place = np.argsort(merged, kind="stable")
        levels.append(place < n)  # which items of this level are leaves; leaves and packages both keep their order
        weights = merged[place]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    lengths[:take] += 1
    result = np.empty(n, np.int64)
    result[order] = lengths
    return result


class Codes:
    """Canonical codes of ids by their lengths."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.uint32), lengths[order].astype(np.int64)
        self.max_bits = int(self.lengths.max()) if self.lengths.size else 1
        # In canonical order the codes, aligned to the longest, are the running sums of their shares of the code space.
        share = np.left_shift(1, self.max_bits - self.lengths)
        self.aligned = np.cumsum(share) - share

    def encoding(self) -> tuple[np.ndarray, np.ndarray]:
        size = int(self.ids.max()) + 1 if self.ids.size else 1
        codes, lengths = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        codes[self.ids] = self.aligned >> (self.max_bits - self.lengths)
        lengths[self.ids] = self.lengths
        return codes, lengths

    def decoding(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and length by the next ``max_bits`` bits."""
        share = np.left_shift(1, self.max_bits - self.lengths)
        ids, lengths = np.zeros(1 << self.max_bits, np.uint32), np.ones(1 << self.max_bits, np.int64)
        filled = int(share.sum())
        ids[:filled], lengths[:filled] = np.repeat(self.ids, share), np.repeat(self.lengths, share)
        return ids, lengths


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit string of ids, most significant bit first, and the bit offset of every ``BLOCK``-th id."""
    if not ids.size:
        return b"", np.zeros(0, np.int64)
    size = lengths[ids]
    end = np.cumsum(size)
    begin = end - size
    words = np.zeros(int(end[-1]) // 32 + 2, np.uint64)
    # A code of at most 32 bits lies in the word where it begins and the next one.
    word = begin >> 5
    wide = codes[ids] << (64 - size - (begin & 31)).astype(np.uint64)
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[heads]] |= np.bitwise_or.reduceat(wide >> np.uint64(32), heads)
    words[word[heads] + 1] |= np.bitwise_or.reduceat(wide & np.uint64(0xFFFFFFFF), heads)
    return words.astype(">u4").tobytes()[:(int(end[-1]) + 7) // 8], begin[::BLOCK].copy()


def decode_bits(payload: bytes, checkpoints: np.ndarray, n: int, ids: np.ndarray, lengths: np.ndarray, max_bits: int) -> np.ndarray:
    """The ``n`` ids of a bit string; all blocks step together."""
    if not n:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8)
    # The 32 bits from each byte on: a code of at most 25 bits that begins in a byte lies in them.
    windows = (raw[:-3].astype(np.uint32) << 24) | (raw[1:-2].astype(np.uint32) << 16) | (raw[2:-1].astype(np.uint32) << 8) | raw[3:]
    at = checkpoints.astype(np.int64)
    out = np.zeros((at.size, BLOCK), np.uint32)
    last = n - (at.size - 1) * BLOCK
    for i in range(min(BLOCK, n)):
        if i == last and at.size:  # the last block is shorter
            at = at[:-1]
        if not at.size:
            break
        look = (windows[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - max_bits)
        out[:at.size, i] = ids[look]
        at = at + lengths[look]
    return out.reshape(-1)[:n]


SEGMENTS = T.StructType([
    T.StructField("first_doc", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("n_ids", T.LongType()),
    T.StructField("checkpoints", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType()),
])


def write_corpus(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode all documents and write the corpus folder."""
    spark = docs.sparkSession
    tokens = tokenized(docs, tokenizer, end_id)
    counts = materialize(id_counts(tokens), "id-counts").orderBy("id").toPandas()  # at most the vocabulary
    ids, lengths = counts["id"].to_numpy(np.int64), code_lengths(counts["count"].to_numpy(np.int64))
    spark.createDataFrame(
        [(int(i), int(n)) for i, n in zip(ids, lengths)], "id int, length int").coalesce(1).write.parquet(f"{path}/codes")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sizes = Codes(ids, lengths).encoding()
        held: list[tuple[int | None, np.ndarray]] = []
        total = 0
        for batch in batches:
            for doc_id, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append((doc_id, _unpacked(packed.as_py())))
                total += held[-1][1].size
                if total >= segment_ids:
                    yield _segment(held, codes, sizes)
                    held, total = [], 0
        if held:
            yield _segment(held, codes, sizes)

    ordered = tokens.select("doc_id", "ids", "crc").repartitionByRange("doc_id", "crc").sortWithinPartitions("doc_id", "crc")
    ordered.select("doc_id", "ids").mapInArrow(each, SEGMENTS).write.parquet(f"{path}/segments")


def _segment(held: list, codes: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    ids = np.concatenate([x for _, x in held])
    payload, checkpoints = encode_bits(ids, codes, sizes)
    names = [d for d, _ in held]
    return pa.RecordBatch.from_pydict({
        "first_doc": pa.array([names[0]], pa.int64()), "doc_ids": pa.array([names], pa.list_(pa.int64())),
        "counts": pa.array([[x.size for _, x in held]], pa.list_(pa.int64())), "n_ids": pa.array([ids.size], pa.int64()),
        "checkpoints": pa.array([checkpoints], pa.list_(pa.int64())), "payload": pa.array([payload], pa.binary()),
    })


def read_corpus(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32`` (and ``ids``) of every document, decoded from the folder."""
    codes = spark.read.schema("id int, length int").parquet(f"{path}/codes").toPandas()
    ids, lengths = codes["id"].to_numpy(np.int64), codes["length"].to_numpy(np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Codes(ids, lengths)
        by_bits, size_by_bits = code.decoding()
        for batch in batches:
            for row in range(batch.num_rows):
                names, counts, n, checkpoints, payload = (batch.column(c)[row] for c in range(1, 6))
                found = decode_bits(payload.as_py(), checkpoints.values.to_numpy(), n.as_py(), by_bits, size_by_bits, code.max_bits)
                sizes = counts.values.to_numpy()
                ends = np.cumsum(sizes)
                parts = [found[e - s:e].astype("<u4").tobytes() for s, e in zip(sizes, ends)]
                columns = [names.values, counts.values, pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in parts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_crc32", "ids"][:len(columns)])

    schema = "doc_id long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    return segments.mapInArrow(each, schema)


def token_table(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the corpus, read it back: ``doc_id, start, n_tokens, ids_crc32``."""
    path = path or fresh_path(docs.sparkSession, "corpus")
    write_corpus(docs, path, tokenizer)
    read = materialize(read_corpus(docs.sparkSession, path), "corpus-read")
    return stream_starts(read, "n_tokens", ties=("ids_crc32",)).select("doc_id", "start", "n_tokens", "ids_crc32")
