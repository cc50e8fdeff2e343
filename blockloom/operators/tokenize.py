"""Tokenizers: text to ``ARRAY<INT>``.

All tokenizers share the special ids below and add no special tokens themselves.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.session import materialize, small_batches
from blockloom.sources.storage import locate

PAD_ID, EOS_ID, UNK_ID, FIRST_ID = 0, 1, 2, 3
BYTE_VOCAB_SIZE = 256 + FIRST_ID

# Fixed value: what counts as one piece for the vocabulary tokenizer.
PIECE_PATTERN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"

# What public tokenizers call their end and padding tokens, the first that is there counts.
END_TOKENS = ("</s>", "<|endoftext|>", "<|end_of_text|>", "<eos>", "[SEP]")
PAD_TOKENS = ("<pad>", "[PAD]", "<|pad|>", "<|padding|>")



def byte_tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of a batch of texts. The Arrow buffers already are UTF-8 bytes; only the values shift."""
    binary = text.cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], dtype=np.int64)[binary.offset:binary.offset + len(binary) + 1]
    data = binary.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data else np.empty(0, np.uint8)
    return offsets - offsets[0], raw.astype(np.int32) + np.int32(FIRST_ID)


def list_tokens(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of a batch of id lists."""
    offsets = ids.offsets.to_numpy()
    return offsets - offsets[0], ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _byte_ids(text: pa.Array) -> pa.Array:
    offsets, ids = byte_tokens(text)
    mask = pa.compute.is_null(text) if text.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids), mask=mask)


class ByteTokenizer:
    """UTF-8 byte value + 3; the token count is known from the text length alone."""

    name = "bytes"
    vocab_size = BYTE_VOCAB_SIZE
    eos_id, pad_id = EOS_ID, PAD_ID

    def ids(self, text: Column) -> Column:
        return _byte_ids(text)

    def count(self, text: Column) -> Column:
        return F.octet_length(text)

    def encode(self, docs: DataFrame, ord_col: str = "ord", text: str = "text") -> DataFrame:
        """Add ``ids`` and ``n_ids``, drop the text; the row order key stays."""
        return docs.select(
            *[c for c in docs.columns if c != text],
            self.count(F.col(text)).cast("long").alias("n_ids"), self.ids(F.col(text)).alias("ids"),
        )


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE_PATTERN), F.lit(0))


def build_vocabulary(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """``(piece, id)`` of the ``size`` most frequent pieces, ties by piece.

    The limit runs as a distributed top-k; only the ``size`` winners reach the final numbering.
    """
    counts = docs.select(F.explode(pieces(F.col(text))).alias("piece")).groupBy("piece").count()
    top = counts.orderBy(F.desc("count"), "piece").limit(size)
    # At most ``size`` rows: one short list, numbered in place.
    entry = F.struct((-F.col("count")).alias("order"), "piece")
    ranked = top.agg(F.sort_array(F.collect_list(entry)).alias("entries")).select(
        F.posexplode("entries").alias("_rank", "entry")
    ).select("_rank", "entry.piece")
    return ranked.select("piece", (F.col("_rank") + F.lit(FIRST_ID)).cast("int").alias("id"))


class VocabTokenizer:
    """Regex pieces looked up in a vocabulary table; unknown pieces become ``UNK_ID``."""

    name = "vocab"
    eos_id, pad_id = EOS_ID, PAD_ID

    def __init__(self, vocabulary: DataFrame, size: int):
        self.vocabulary = vocabulary
        self.vocab_size = size + FIRST_ID

    def encode(self, docs: DataFrame, ord_col: str = "ord", text: str = "text") -> DataFrame:
        """Add ``ids`` and ``n_ids``, drop the text.

        The vocabulary, at most ``size`` short entries, goes to every task once; pieces are looked up where they are,
        a whole Arrow batch at a time, so documents neither explode into rows nor move.
        """
        rows = self.vocabulary.toArrow().select(["piece", "id"])
        known, numbers = rows["piece"].combine_chunks(), np.append(rows["id"].to_numpy(), UNK_ID).astype(np.int32)

        @F.arrow_udf("array<int>")
        def look_up(batch: pa.Array) -> pa.Array:
            found = pc.fill_null(pc.index_in(batch.flatten(), value_set=known), len(known)).to_numpy(zero_copy_only=False)
            offsets = pa.array(batch.offsets.to_numpy() - batch.offsets[0].as_py(), pa.int32())
            return pa.ListArray.from_arrays(offsets, pa.array(numbers[found]))

        carry = [c for c in docs.columns if c not in (text, ord_col)]
        found = F.coalesce(pieces(F.col(text)), F.array().cast("array<string>"))
        coded = docs.select(ord_col, *carry, look_up(found).alias("ids"))
        return coded.select(ord_col, *carry, F.size("ids").cast("long").alias("n_ids"), "ids")


class FileTokenizer:
    """Any ``tokenizer.json``, applied to Arrow batches; its text is broadcast, so files may share a name.

    ``eos_id`` and ``pad_id`` are those of its special tokens of the usual names, None where it has none.
    """

    def __init__(self, spark: SparkSession, path: str):
        from tokenizers import Tokenizer

        system, plain = locate(path)
        with system.open_input_file(plain) as source:
            spec = source.read().decode("utf-8")
        self.name = path.rstrip("/").rsplit("/", 1)[-1]
        # A tokenizer that does not load is an error; nothing silently takes its place.
        loaded = Tokenizer.from_str(spec)
        self.vocab_size = loaded.get_vocab_size()
        special = [t.content for t in loaded.get_added_tokens_decoder().values() if t.special]
        self.eos_id = next((loaded.token_to_id(t) for t in END_TOKENS if t in special), None)
        padding = (loaded.padding or {}).get("pad_token")
        self.pad_id = next((loaded.token_to_id(t) for t in (padding, *PAD_TOKENS) if t in special), None)
        self._spec = spark.sparkContext.broadcast(spec)

    def encode(self, docs: DataFrame, ord_col: str = "ord", text: str = "text") -> DataFrame:
        small_batches(docs.sparkSession)
        spec = self._spec
        carry = [f for f in docs.schema.fields if f.name != text]
        schema = T.StructType(
            [*carry, T.StructField("n_ids", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
        )

        def encode_batches(batches):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(spec.value)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            for batch in batches:
                texts = batch.column(batch.num_columns - 1).to_pylist()
                ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array([len(i) for i in ids], pa.int64()),
                     pa.array(ids, pa.list_(pa.int32()))],
                    names=[*batch.schema.names[:-1], "n_ids", "ids"],
                )

        return docs.select(*[f.name for f in carry], text).mapInArrow(encode_batches, schema)


def load_tokenizer(spark: SparkSession, name: str, fallback: str | None = None):
    """``bytes``, or the path of a ``tokenizer.json``. A tokenizer that does not load is an error unless a
    ``fallback`` was asked for, and then a warning says so."""
    if name == ByteTokenizer.name:
        return ByteTokenizer()
    try:
        return FileTokenizer(spark, name)
    except Exception as error:
        if fallback is None:
            raise ValueError(f"tokenizer {name!r} does not load: {error}") from error
        warnings.warn(f"tokenizer {name!r} does not load ({error}); using {fallback!r}", stacklevel=2)
        return load_tokenizer(spark, fallback)


def tokenize(docs: DataFrame, tokenizer, ord_col: str = "ord") -> DataFrame:
    """Token ids per document, written once so that later passes do not tokenize again."""
    return materialize(tokenizer.encode(docs, ord_col), "tokens")


def sequence_estimate(tokenized: DataFrame, block_size: int, add_eos: bool = True) -> DataFrame:
    """Total tokens and how many sequences of ``block_size`` they make."""
    total = F.coalesce(F.sum(F.col("n_ids") + F.lit(1 if add_eos else 0)), F.lit(0))
    return tokenized.agg(total.cast("long").alias("total_tokens")).withColumn(
        "n_sequences", F.expr(f"total_tokens div {int(block_size)}")
    )
