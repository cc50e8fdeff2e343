"""Streaming packer: the unfinished block of every lane is carried as state between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from blockloom.fixed import SEED
from blockloom.functions.draws import draw_below
from blockloom.operators.packing import finish_tail
from blockloom.operators.tokenize import EOS_ID, PAD_ID, ByteTokenizer
from blockloom.session import STATE_STORE, small_batches

OUTPUT = "lane STRING, block_id BIGINT, complete BOOLEAN, tokens ARRAY<INT>"


class PackProcessor(StatefulProcessor):
    """Appends documents to the carried tail and emits every full block.

    The tail is also emitted, marked incomplete, so that a reader can take the latest one as the flush.
    """

    def __init__(self, width: int, eos_id: int):
        self.width, self.eos_id = width, eos_id

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", "next_block BIGINT, ids ARRAY<INT>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        next_block, carried = self.tail.get() if self.tail.exists() else (0, [])
        pending = np.asarray(carried, dtype=np.int32)
        for batch in rows:
            parts = [pending]
            for ids in batch["ids"]:
                parts += [np.asarray(ids, dtype=np.int32), np.array([self.eos_id], dtype=np.int32)]
            stream = np.concatenate(parts)
            n_full = len(stream) // self.width
            full, pending = stream[: n_full * self.width].reshape(n_full, self.width), stream[n_full * self.width:]
            if n_full:
                yield self._rows(key, range(next_block, next_block + n_full), True, list(full))
                next_block += n_full
        self.tail.update((next_block, pending.tolist()))
        yield self._rows(key, [next_block], False, [pending])

    def _rows(self, key, numbers, complete: bool, tokens: list) -> pd.DataFrame:
        return pd.DataFrame({"lane": key[0], "block_id": list(numbers), "complete": complete, "tokens": tokens})

    def close(self) -> None:
        pass


def lanes(source: str, document: str, per_source: int, seed: int = SEED) -> Column:
    """Lane name of a document: its source and one of ``per_source`` hash classes.

    A lane is packed by one task at a time, so a busy source gets as many lanes as its rate needs.
    """
    drawn = draw_below(F.lit(per_source).cast("long"), seed, F.col(document))
    return F.concat_ws("/", F.col(source), drawn.cast("string"))


def stream_pack(docs: DataFrame, block_size: int, lane: str = "lane", tokenizer=None, eos_id: int = EOS_ID) -> DataFrame:
    """``(lane, block_id, complete, tokens)`` of a stream ``(lane, text)``, in arrival order per lane."""
    tokenizer = tokenizer or ByteTokenizer()
    # Map state needs the RocksDB store; memory then holds the tails of the lanes in use, nothing more.
    docs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    small_batches(docs.sparkSession)
    ids = docs.select(F.col(lane).alias("lane"), tokenizer.ids(F.col("text")).alias("ids"))
    return ids.groupBy("lane").transformWithStateInPandas(
        statefulProcessor=PackProcessor(block_size + 1, eos_id), outputStructType=OUTPUT,
        outputMode="Append", timeMode="None",
    )


def flushed_blocks(packed: DataFrame, block_size: int, pad_id: int = PAD_ID) -> DataFrame:
    """Blocks of the written stream so far: all full ones, and the latest tail of every lane, padded."""
    tails = packed.where(~F.col("complete")).groupBy("lane").agg(
        F.max(F.struct("block_id", F.size("tokens").alias("n"), "tokens")).alias("last")
    ).select("lane", "last.block_id", "last.tokens")
    full = packed.where("complete").select("lane", "block_id", "tokens")
    return finish_tail(full.unionByName(tails), block_size, pad_id)
