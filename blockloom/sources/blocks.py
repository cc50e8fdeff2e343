"""Packed training rows read back: through a manifest, from a directory, or from flat files."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.fixed import BLOCK_SIZE
from blockloom.operators.manifests import MANIFEST_SCHEMA, existing_shards, has_files, running_offset, shard_files
from blockloom.sources.arrow_ipc import read_arrow
from blockloom.sources.flat_tokens import read_runs
from blockloom.sources.gather import count_rows

SPLITS = ("train", "val")


# A shard is known by the folder of its dataset, its split and its number.
SHARD_KEYS = ["dataset", "split", "shard_idx"]
SHARD_PATH = {
    "parquet": r"^(.*)/split=(\w+)/shard_idx=(\d+)(?:/[^/]*)?$", "arrow": r"^(.*)/(\w+)_shard_(\d+)\.arrow$",
}


def _read_shards(spark: SparkSession, paths: list[str], layout: str) -> DataFrame:
    """``(*SHARD_KEYS, row, input_ids, labels, length)``; ``row`` is the position inside the shard."""
    if layout == "parquet":
        rows = spark.read.parquet(*paths)
        path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    else:
        rows = read_arrow(spark, *paths, rows="true")
        path, row = F.col("_file"), F.col("_row")
    dataset, split, number = (F.regexp_extract(path, SHARD_PATH[layout], group) for group in (1, 2, 3))
    return rows.select(
        # Spark and Arrow write local paths with different numbers of slashes.
        F.regexp_replace(dataset, "^file:/+", "/").alias("dataset"), split.alias("split"),
        number.cast("long").alias("shard_idx"), row.alias("row"), "input_ids", "labels", "length",
    )


def _manifest_paths(spark: SparkSession, manifest_path: str, split: str, block_size: int | None) -> list[tuple[str, list[str]]]:
    """Layouts and paths of the existing shards that a manifest lists."""
    row = spark.read.schema(MANIFEST_SCHEMA).json(manifest_path, multiLine=True)
    head = row.select("block_size", F.explode(f"{split}_shards").alias("path"))
    first = head.first()
    if first is None:
        raise ValueError(f"no {split}_shards in {manifest_path}")
    if block_size is not None and first["block_size"] != block_size:
        warnings.warn(f"the manifest has block size {first['block_size']}, not {block_size}; using it", stacklevel=3)
    parts = []
    for layout, below in (("parquet", r"/split=[^/]+/shard_idx=[^/]+$"), ("arrow", r"/[^/]+\.arrow$")):
        listed = head.where(F.col("path").endswith(".arrow") == (layout == "arrow"))
        # One folder per pooled dataset; of each only the listing is read.
        folders = [r[0] for r in listed.select(F.regexp_replace("path", below, "")).distinct().collect()]
        patterns = [f"{f}/*.arrow" if layout == "arrow" else f"{f}/split={split}/*/*.parquet" for f in sorted(folders)]
        patterns = [p for p in patterns if has_files(spark, p)]
        if not patterns:
            continue
        paths = [r["path"] for r in existing_shards(listed, shard_files(spark, *patterns)).select("path").collect()]
        if paths:
            parts.append((layout, sorted(paths)))
    if not parts:
        raise FileNotFoundError(f"none of the {split} shards in {manifest_path} exists")
    return parts


def read_manifest_blocks(
    spark: SparkSession, manifest_path: str, split: str = "train", block_size: int | None = None
) -> DataFrame:
    """Rows of the shards a manifest lists for a split; files that are gone are left out.

    The block size of the manifest wins over ``block_size``. The shard list is file-level metadata; the rows
    never pass the driver.
    """
    parts = [_read_shards(spark, paths, layout) for layout, paths in _manifest_paths(spark, manifest_path, split, block_size)]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _dir_paths(spark: SparkSession, directory: str, split: str, layout: str) -> list[str]:
    if layout == "parquet":
        return [f"{directory}/split={split}/*"]
    from blockloom.sources.storage import list_files

    pattern = f"{directory}/{split}_shard_*.arrow"  # not the names: every read would carry the list of them
    if not list_files([pattern], (".arrow",)):
        raise FileNotFoundError(f"no {split} shards in {directory}")
    return [pattern]


def read_dir_blocks(spark: SparkSession, directory: str, split: str = "train", layout: str = "parquet") -> DataFrame:
    """Rows of all shards of a split below a directory, found by name."""
    return _read_shards(spark, _dir_paths(spark, directory, split, layout), layout)


def block_shards(
    spark: SparkSession, split: str = "train", manifest: str | None = None, directory: str | None = None,
    layout: str = "parquet", block_size: int | None = None,
) -> DataFrame:
    """``(*SHARD_KEYS, path, layout, n_rows, offset)`` of the shard files that a manifest lists or a directory holds.

    Rows are counted from footers and batch headers; ``offset`` is the number of rows in earlier shards.
    """
    if (manifest is None) == (directory is None):
        raise ValueError("shards need a manifest or a directory")
    if manifest is not None:
        listed = _manifest_paths(spark, manifest, split, block_size)
    else:
        listed = [(layout, _dir_paths(spark, directory, split, layout))]
    parts = None
    for kind, paths in listed:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
            "pathGlobFilter", f"*.{kind}").load(paths).select("path")
        keys = [F.regexp_extract("path", SHARD_PATH[kind], group) for group in (1, 2, 3)]
        files = files.select(
            F.regexp_replace(keys[0], "^file:/+", "/").alias("dataset"), keys[1].alias("split"),
            keys[2].cast("long").alias("shard_idx"), "path", F.lit(kind).alias("layout"))
        parts = files if parts is None else parts.unionByName(files)
    return running_offset(count_rows(parts), [*SHARD_KEYS, "path"], "n_rows")


def read_blocks(
    spark: SparkSession, split: str = "train", data_format: str = "bin", manifest: str | None = None,
    train_dir: str | None = None, val_dir: str | None = None, train_bin: str | None = None, val_bin: str | None = None,
    block_size: int = BLOCK_SIZE, layout: str = "parquet",
) -> DataFrame:
    """Choose the reader the way the settings say: manifest, else both directories, else flat files.

    Shards give training rows; flat files give the stream in runs of ``block_size`` for window sampling.
    """
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}; known: train, val")
    if data_format == "bin":
        path = train_bin if split == "train" else val_bin
        if path is None:
            raise ValueError("flat files need train_bin and val_bin")
        return read_runs(spark, path, run=block_size)
    if manifest is not None:
        return read_manifest_blocks(spark, manifest, split, block_size)
    if train_dir is not None and val_dir is not None:
        return read_dir_blocks(spark, train_dir if split == "train" else val_dir, split, layout)
    raise ValueError("packed shards need a manifest, or both a train and a val directory")
