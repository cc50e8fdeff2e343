"""Reproducible training draws as joins: a whole epoch of batches at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.fixed import SEED, SYNTHETIC_VOCAB
from blockloom.functions.draws import draw_below
from blockloom.operators.manifests import running_offset
from blockloom.sources.flat_tokens import TOKEN_BYTES, token_files
from blockloom.sources.gather import gather_blocks, gather_windows


def draws(spark: SparkSession, n_draws: int, batch_size: int, bound: int, seed: int = SEED) -> DataFrame:
    """``(step, slot, target)``: uniform targets in [0, bound), with replacement."""
    return spark.range(n_draws).select(
        F.expr(f"id div {int(batch_size)}").alias("step"), (F.col("id") % batch_size).alias("slot"),
        draw_below(F.lit(bound).cast("long"), seed, F.col("id")).alias("target"),
    )


def index_rows(rows: DataFrame, order: list[str], within: str) -> DataFrame:
    """Add ``row_index``, dense over all shards: rows of earlier shards plus the position inside the shard."""
    counts = running_offset(rows.groupBy(*order).agg(F.count(F.lit(1)).alias("_n")), order, "_n")
    return (
        rows.join(counts.select(*order, "offset"), order)
        .withColumn("row_index", F.col("offset") + F.col(within)).drop("offset")
    )


def sample_blocks(
    rows: DataFrame, total_rows: int, steps: int, batch_size: int, seed: int = SEED, index: str = "row_index"
) -> DataFrame:
    """``(step, slot, input_ids, labels)``: every row equally likely at every draw.

    Drawing a shard by its size and then a row of it uniformly is the same as drawing a row uniformly. The
    draws join on the dense row index, so nothing is opened row by row.
    """
    if total_rows <= 0:
        raise ValueError("no blocks to draw from")
    wanted = draws(rows.sparkSession, steps * batch_size, batch_size, total_rows, seed)
    return wanted.join(rows.withColumnRenamed(index, "target"), "target").select(
        "step", "slot", F.col("target").alias("row_index"), "input_ids", "labels"
    )


def sample_windows(
    runs: DataFrame, total_tokens: int, block_size: int, steps: int, batch_size: int, seed: int = SEED
) -> DataFrame:
    """``(step, slot, start, input_ids, labels)``: random windows of the token stream, labels one to the right.

    ``runs`` holds the stream cut into runs of ``block_size`` tokens ``(block_id, tokens)``. A window touches at
    most two neighbouring runs, so it is an equi-join on two keys. All ``total - block_size`` starts are drawn.
    """
    if total_tokens <= block_size:
        raise ValueError(f"{total_tokens} tokens are too few for windows of {block_size}")
    wanted = draws(runs.sparkSession, steps * batch_size, batch_size, total_tokens - block_size, seed)
    first = F.expr(f"target div {int(block_size)}")
    touched = wanted.select("step", "slot", "target", F.explode(F.array(first, first + 1)).alias("block_id"))
    parts = F.sort_array(F.collect_list(F.struct("block_id", "tokens")))
    windows = touched.join(runs.select("block_id", "tokens"), "block_id").groupBy("step", "slot", "target").agg(
        F.flatten(F.transform(parts, lambda p: p["tokens"])).alias("_both")
    )
    at = (F.col("target") % block_size).cast("int")
    return windows.select(
        "step", "slot", F.col("target").alias("start"),
        F.slice("_both", at + 1, F.lit(block_size)).alias("input_ids"),
        F.slice("_both", at + 2, F.lit(block_size)).alias("labels"),
    )


def draw_from_shards(shards: DataFrame, block_size: int, steps: int, batch_size: int, seed: int = SEED) -> DataFrame:
    """``sample_blocks`` of written shards: the draws go to the shard files, no block is moved.

    ``shards`` is the table of ``sources.blocks.block_shards``; only its file names and row counts reach the driver.
    """
    listed = [(r["path"], r["layout"], r["n_rows"]) for r in shards.orderBy("offset", "path").collect()]
    total = sum(n for _, _, n in listed)
    if total <= 0:
        raise ValueError("no blocks to draw from")
    n_draws = steps * batch_size
    return gather_blocks(draws(shards.sparkSession, n_draws, batch_size, total, seed), n_draws, listed, block_size)


def draw_from_files(spark: SparkSession, paths: list[str], block_size: int, steps: int, batch_size: int, seed: int = SEED) -> DataFrame:
    """``sample_windows`` of flat token files: each window is read where it lies, labels one to the right."""
    files = token_files(paths)
    total = sum(size for _, size in files) // TOKEN_BYTES
    if total <= block_size:
        raise ValueError(f"{total} tokens are too few for windows of {block_size}")
    n_draws = steps * batch_size
    return gather_windows(draws(spark, n_draws, batch_size, total - block_size, seed), n_draws, files, block_size)


def synthetic_tokens(
    spark: SparkSession, n_tokens: int, vocab_size: int = SYNTHETIC_VOCAB, seed: int = SEED, val_fraction: float = 0.05
) -> DataFrame:
    """``(pos, token, split)``: uniform ids, the last ``val_fraction`` of the positions for validation."""
    cut = int(n_tokens * (1.0 - val_fraction))
    return spark.range(n_tokens).select(
        F.col("id").alias("pos"),
        draw_below(F.lit(vocab_size).cast("long"), seed, F.col("id")).cast("int").alias("token"),
        F.when(F.col("id") < cut, "train").otherwise("val").alias("split"),
    )

