"""Train and validation splits that come out the same for any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.fixed import SEED, VAL_FRACTION
from blockloom.functions.draws import draw_hex, draw_unit
from blockloom.operators.packing import cut_pieces, place_documents


def split_shards(
    shards: DataFrame,
    val_fraction: float = VAL_FRACTION,
    val_shards: int = 0,
    seed: int = SEED,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``split`` and ``split_idx`` to a table of distinct ``(*keys, shard_idx)``.

    Shards are put in a seeded random order; the first ``val_shards``, or ``val_fraction`` of them but at least
    one, validate. Both splits are numbered from 0 in that order. The table has one row per shard file
    (50 million tokens), never one per block, which is why ranking it in one window per dataset is safe.
    """
    shuffled = Window.partitionBy(*keys).orderBy(draw_hex(seed, *[F.col(k) for k in keys], F.col("shard_idx")), "shard_idx")
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    n_val = (
        F.lit(val_shards).cast("long") if val_shards > 0
        else F.greatest(F.lit(1).cast("long"), (total * F.lit(float(val_fraction))).cast("long"))
    )
    ranked = shards.select(*keys, "shard_idx", F.row_number().over(shuffled).alias("_rank"), n_val.alias("_n_val"))
    is_val = F.col("_rank") <= F.col("_n_val")
    return ranked.select(
        *keys, "shard_idx",
        F.when(is_val, "val").otherwise("train").alias("split"),
        F.when(is_val, F.col("_rank") - 1).otherwise(F.col("_rank") - 1 - F.col("_n_val")).cast("long").alias("split_idx"),
    )


def split_blocks(blocks: DataFrame, val_fraction: float = VAL_FRACTION, seed: int = SEED) -> DataFrame:
    """Add ``split`` by one independent draw per block."""
    drawn = draw_unit(seed, F.col("block_id"))
    return blocks.withColumn("split", F.when(drawn < F.lit(float(val_fraction)), "val").otherwise("train"))


def split_position(
    docs: DataFrame, val_fraction: float, total_tokens: int, tokenizer=None, eos_id: int | None = 1
) -> DataFrame:
    """Cut the token stream at ``int(total * (1 - fraction))``: ``(split, start, ids)``.

    The document on the border is sliced; its tail starts the validation part.
    """
    cut = int(total_tokens * (1.0 - val_fraction))
    placed = place_documents(docs, tokenizer, (), eos_id)
    # Runs of ``cut`` tokens: the first one is the training part. A cut at 0 leaves nothing for it.
    pieces = cut_pieces(placed, cut or max(1, total_tokens), (), eos_id)
    in_train = (F.col("block_id") == 0) & F.lit(cut > 0)
    return pieces.select(
        F.when(in_train, "train").otherwise("val").alias("split"),
        F.when(in_train, F.col("at")).otherwise(F.col("at") - cut).alias("start"), F.col("part").alias("ids"),
    )
