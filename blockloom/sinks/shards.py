"""Packed-block shards: Parquet partitions by default, Arrow IPC files on request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators.manifests import directory_value
from blockloom.operators.packing import shift_labels
from blockloom.sinks.token_files import write_token_files

COMPRESSIONS = ("lz4", "zstd", "none")


def _with_split(blocks: DataFrame, shards: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Attach the split without moving the blocks: they lie hashed by these keys, so only the shard table moves."""
    return blocks.join(shards.hint("shuffle_hash"), [*keys, "shard_idx"])


def _clear(spark: SparkSession, path: str, name: str) -> None:
    """Remove the partition folders ``name=…`` of an earlier run; anything else below ``path`` stays."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(root):
        for found in system.listStatus(root):
            if found.getPath().getName().startswith(f"{name}="):
                system.delete(found.getPath(), True)


def write_block_shards(
    blocks: DataFrame, shards: DataFrame, path: str, layout: str = "parquet", compression: str = "zstd",
    keys: tuple[str, ...] = (),
) -> None:
    """Write ``(*keys, shard_idx, block_id, tokens)`` as training rows, one file per shard.

    The blocks must be gathered per shard, as packing with ``blocks_per_shard`` leaves them; they are not shuffled
    again. ``shards`` is the split table ``(*keys, shard_idx, split, split_idx)``. Rerunning replaces the
    shards, it never adds to them; other files of the folder stay.
    """
    if compression not in COMPRESSIONS:
        raise ValueError(f"unknown compression {compression!r}; known: {', '.join(COMPRESSIONS)}")
    rows = shift_labels(_with_split(blocks, shards, keys))
    if layout == "parquet":
        out = rows.select(*keys, "split", F.col("split_idx").alias("shard_idx"), "block_id", "input_ids", "labels", "length")
        out = out.sortWithinPartitions(*keys, "split", "shard_idx", "block_id")
        codec = {"none": "uncompressed"}.get(compression, compression)
        _clear(blocks.sparkSession, path, (*keys, "split")[0])
        out.write.mode("append").option("compression", codec).partitionBy(*keys, "split", "shard_idx").parquet(path)
        return
    if layout != "arrow":
        raise ValueError(f"unknown layout {layout!r}; known: parquet, arrow")
    if len(keys) > 1:
        raise ValueError("Arrow shards lie in folders of one key")
    name = F.concat("split", F.lit("_shard_"), F.lpad(F.col("split_idx").cast("string"), 5, "0"), F.lit(".arrow"))
    if keys:
        name = F.concat(F.lit(f"{keys[0]}="), directory_value(F.col(keys[0])), F.lit("/"), name)
    out = rows.sortWithinPartitions(*keys, "split", "split_idx", "block_id")
    write_token_files(
        out.select(name.alias("file_name"), "input_ids", "labels", "length"), path, "arrow", compression, *keys)
