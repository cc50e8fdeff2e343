"""Packing: documents end to end with an EOS after each, cut into disjoint blocks of ``block_size + 1`` tokens.

The token stream never exists as a whole. A running total of the document lengths gives every document its
place in the stream; each document then yields the slices that fall into each block, and the slices of one
block, at most ``block_size + 1`` tokens together, are put in order again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.fixed import BLOCK_SIZE, SHARD_TOKENS
from blockloom.operators.order import with_start
from blockloom.operators.tokenize import EOS_ID, PAD_ID, ByteTokenizer, byte_tokens, list_tokens
from blockloom.session import materialize, small_batches


def shard_blocks(block_size: int = BLOCK_SIZE, shard_tokens: int = SHARD_TOKENS) -> int:
    """Blocks per shard."""
    return max(1, shard_tokens // block_size)


def place_documents(
    docs: DataFrame, tokenizer=None, keys: tuple[str, ...] = (), eos_id: int | None = EOS_ID, ord_col: str = "ord"
) -> DataFrame:
    """``(*keys, start, n, text | ids)``: the place of every document in the stream, its EOS counted in ``n``.

    ``docs`` holds either ``ids`` and ``n_ids``, or ``text`` together with a ``tokenizer``. A tokenizer that knows
    the count beforehand leaves the text as it is, so the shuffle carries text and not token ids; the output of
    any other tokenizer is written first, because lengths and ids are needed in two passes.
    """
    tail = F.lit(1 if eos_id is not None else 0)
    if "ids" in docs.columns:
        payload, sized = "ids", docs.withColumn("n", F.col("n_ids") + tail)
    elif hasattr(tokenizer, "count"):
        # A count stored beside the text keeps the passes over lengths from reading the texts.
        count = F.col("n_ids") if "n_ids" in docs.columns else tokenizer.count(F.col("text")).cast("long")
        payload, sized = "text", docs.withColumn("n", count + tail)
    else:
        return place_documents(materialize(tokenizer.encode(docs, ord_col), "tokens"), None, keys, eos_id, ord_col)
    placed = with_start(sized.select(*keys, ord_col, "n", payload), "n", keys, ord_col)
    return placed.select(*keys, "start", "n", payload)


def _cutter(width: int, eos_id: int | None):
    """Arrow function ``(start, text | ids) -> pieces``; works on whole batches, never on single tokens."""

    @F.arrow_udf("array<struct<block_id: bigint, at: bigint, part: array<int>>>")
    def cut(start: pa.Array, body: pa.Array) -> pa.Array:
        offsets, tokens = byte_tokens(body) if pa.types.is_string(body.type) or pa.types.is_large_string(body.type) \
            else list_tokens(body)
        sizes = np.diff(offsets)
        if eos_id is not None:
            sizes = sizes + 1
            ends = np.cumsum(sizes)
            joined = np.full(int(sizes.sum()), eos_id, dtype=np.int32)
            real = np.ones(len(joined), dtype=bool)
            real[ends - 1] = False
            joined[real] = tokens
            tokens = joined
        begins = np.cumsum(sizes) - sizes
        places = start.to_numpy(zero_copy_only=False).astype(np.int64)
        first = places // width
        n_pieces = np.where(sizes > 0, (places + sizes - 1) // width - first + 1, 0)
        piece_ends = np.cumsum(n_pieces)
        doc = np.repeat(np.arange(len(sizes)), n_pieces)
        block = first[doc] + np.arange(len(doc)) - (piece_ends - n_pieces)[doc]
        at = np.maximum(places[doc], block * width)
        edges = np.append(at - places[doc] + begins[doc], len(tokens))
        parts = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(tokens, pa.int32()))
        pieces = pa.StructArray.from_arrays([pa.array(block), pa.array(at), parts], names=["block_id", "at", "part"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, piece_ends), pa.int32()), pieces)

    return cut


def cut_pieces(
    placed: DataFrame, width: int, keys: tuple[str, ...] = (), eos_id: int | None = None
) -> DataFrame:
    """``(*keys, block_id, at, part)``: each document's share of every run of ``width`` tokens it reaches.

    With ``eos_id`` the EOS counted in ``n`` is put behind every document. Each token leaves its document once,
    however many runs a long document spans.
    """
    small_batches(placed.sparkSession)
    body = "text" if "text" in placed.columns else "ids"
    pieces = _cutter(width, eos_id)(F.col("start"), F.col(body))
    return placed.select(*keys, F.explode(pieces).alias("p")).select(*keys, "p.block_id", "p.at", "p.part")


def cut_stream(
    placed: DataFrame, width: int, keys: tuple[str, ...] = (), group: int | None = None, eos_id: int | None = None
) -> DataFrame:
    """Cut placed documents into runs of ``width`` tokens: ``(*keys, block_id, tokens)``; the last run may be short.

    With ``group``, runs are gathered per ``block_id div group``, a shard: one shuffle then serves the
    reassembly of the blocks and a later write by shard (column ``shard_idx``).
    """
    pieces = cut_pieces(placed, width, keys, eos_id)
    grouping = [*keys, "block_id"]
    if group:
        pieces = pieces.withColumn("shard_idx", F.expr(f"block_id div {group}")).repartition(*keys, "shard_idx")
        grouping = [*keys, "shard_idx", "block_id"]
    ordered = F.sort_array(F.collect_list(F.struct("at", "part")))
    return pieces.groupBy(*grouping).agg(F.flatten(ordered["part"]).alias("tokens"))


def finish_tail(blocks: DataFrame, block_size: int, pad_id: int = PAD_ID) -> DataFrame:
    """Pad the short last block to full width; a tail of a single token is dropped."""
    missing = F.lit(block_size + 1) - F.size("tokens")
    padding = F.array_repeat(F.lit(pad_id).cast("int"), missing)
    return blocks.where(F.size("tokens") >= 2).withColumn(
        "tokens", F.when(missing > 0, F.concat("tokens", padding)).otherwise(F.col("tokens"))
    )


def pack_blocks(
    docs: DataFrame,
    block_size: int = BLOCK_SIZE,
    tokenizer=None,
    keys: tuple[str, ...] = (),
    eos_id: int = EOS_ID,
    pad_id: int = PAD_ID,
    blocks_per_shard: int | None = None,
    flush: bool = True,
) -> DataFrame:
    """``(*keys, [shard_idx,] block_id, tokens)``, every block ``block_size + 1`` tokens long.

    With ``keys`` each key value (a dataset, never null) is packed into blocks of its own. ``flush=False`` leaves out the
    incomplete last block.
    """
    placed = place_documents(docs, tokenizer or ByteTokenizer(), keys, eos_id)
    blocks = cut_stream(placed, block_size + 1, keys, blocks_per_shard, eos_id)
    if not flush:
        return blocks.where(F.size("tokens") == block_size + 1)
    return finish_tail(blocks, block_size, pad_id)


def pad_blocks(tokenized: DataFrame, block_size: int = BLOCK_SIZE, pad_id: int = PAD_ID) -> DataFrame:
    """Packing switched off: one block of ``block_size`` tokens per document, cut or padded, without EOS."""
    cut = F.slice("ids", 1, block_size)
    padding = F.array_repeat(F.lit(pad_id).cast("int"), F.lit(block_size) - F.size(cut))
    return tokenized.select(
        *[c for c in tokenized.columns if c not in ("ids", "n_ids")], F.concat(cut, padding).alias("tokens")
    )


def shift_labels(blocks: DataFrame) -> DataFrame:
    """Training rows: inputs without the last token, labels without the first, number of non-zero inputs."""
    width = F.size("tokens") - 1
    rows = blocks.select(
        *[c for c in blocks.columns if c != "tokens"],
        F.slice("tokens", F.lit(1), width).alias("input_ids"),
        F.slice("tokens", F.lit(2), width).alias("labels"),
    )
    return rows.withColumn("length", F.size(F.array_remove("input_ids", 0)))


def assign_shards(blocks: DataFrame, blocks_per_shard: int) -> DataFrame:
    return blocks.withColumn("shard_idx", F.expr(f"block_id div {int(blocks_per_shard)}"))


def number_documents(tokenized: DataFrame, ord_col: str = "ord", keys: tuple[str, ...] = ()) -> DataFrame:
    """Unpacked blocks get their document's position as ``block_id``."""
    ones = tokenized.withColumn("_one", F.lit(1).cast("long"))
    return with_start(ones, "_one", keys, ord_col).drop("_one").withColumnRenamed("start", "block_id")
