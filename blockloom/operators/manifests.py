"""Manifests: one JSON document per dataset that names its shards, and the pooling of many of them."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.fixed import COMBINED_KEYS, MANIFEST_KEYS
from blockloom.sources.storage import locate

# All keys with a stable type, so manifests of any origin read alike.
MANIFEST_SCHEMA = """
    format STRING, tokenizer STRING, block_size BIGINT, vocab_size BIGINT, total_blocks BIGINT,
    total_tokens BIGINT, total_docs BIGINT, train_shards ARRAY<STRING>, val_shards ARRAY<STRING>,
    compression STRING, created STRING, source STRING, preset STRING, field_map STRING
"""


def shard_table(totals: DataFrame, blocks_per_shard: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(*keys, shard_idx)`` of all shards that ``total_blocks`` blocks fill; no block is read for it."""
    last = F.expr(f"(total_blocks - 1) div {int(blocks_per_shard)}")
    return totals.where(F.col("total_blocks") > 0).select(
        *keys, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("shard_idx")
    )


def shard_path(base: str, split: Column, index: Column, layout: str = "parquet") -> Column:
    """Where a shard lives: a partition directory, or an Arrow file."""
    if layout == "parquet":
        return F.concat(F.lit(f"{base}/split="), split, F.lit("/shard_idx="), index.cast("string"))
    return F.concat(F.lit(f"{base}/"), split, F.lit("_shard_"), F.lpad(index.cast("string"), 5, "0"), F.lit(".arrow"))


# Fixed value: characters that a partition directory name holds as %XX.
ESCAPED = "%\"#'*/:=?\\{[]^"


def directory_value(value: Column) -> Column:
    """A partition value the way its directory is named."""
    for char in ESCAPED:
        value = F.replace(value, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return value


def bare_path(path: Column) -> Column:
    """A path without scheme and host, so that listed and found paths compare."""
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")


def _listed(split: str, path: str = "path") -> Column:
    """Paths of one split in shard order."""
    entry = F.when(F.col("split") == split, F.struct("split_idx", path))
    return F.transform(F.sort_array(F.collect_list(entry)), lambda e: e[path]).alias(f"{split}_shards")


def manifest(shards: DataFrame, totals: DataFrame, keys: tuple[str, ...] = (), **fields) -> DataFrame:
    """One row per dataset in manifest form.

    ``shards`` holds ``(*keys, split, split_idx, path)``, one row per shard file; ``totals`` comes from
    ``run_stats``. Remaining fields (tokenizer, source, …) are passed by name; missing ones are null.
    """
    lists = shards.groupBy(*keys).agg(_listed("train"), _listed("val"))
    joined = totals.join(lists, list(keys), "left") if keys else totals.crossJoin(lists)  # 1 x 1 rows
    fields.setdefault("created", datetime.datetime.now().strftime("%Y-%m-%dT%H:%M:%S"))
    schema = {f.split()[0]: f.split()[1] for f in MANIFEST_SCHEMA.replace("\n", " ").split(", ")}
    columns = []
    for key in MANIFEST_KEYS:
        if key in ("total_blocks", "total_tokens", "total_docs"):
            columns.append(F.col(key))
        elif key in ("train_shards", "val_shards"):
            columns.append(F.coalesce(F.col(key), F.array().cast("array<string>")).alias(key))
        else:
            value = fields.get(key)
            columns.append((value if isinstance(value, Column) else F.lit(value)).cast(schema[key]).alias(key))
    return joined.select(*keys, *columns)


def write_manifest(row: DataFrame, directory: str) -> None:
    """Write a one-row manifest as ``manifest.json`` below ``directory``."""
    row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{directory}/manifest.json")


def write_manifest_files(rows: DataFrame, path: Column, keys: tuple[str, ...]) -> None:
    """Write each row, without its keys, as a JSON file of its own; a repeated task writes the same file."""
    body = F.to_json(F.struct(*[c for c in rows.columns if c not in keys]), {"ignoreNullFields": "false"})

    def write(found) -> None:
        for name, text in found:
            system, plain = locate(name)
            system.create_dir(plain.rpartition("/")[0], recursive=True)
            with system.open_output_stream(plain) as out:
                out.write(text.encode("utf-8"))

    rows.select(path, body).foreachPartition(write)


def read_manifests(spark: SparkSession, directories: list[str]) -> DataFrame:
    """``(input_order, input_dir, …manifest)``; directories without a manifest are left out."""
    order = {d.rstrip("/"): i for i, d in enumerate(directories)}
    found = [d for d in order if has_files(spark, f"{d}/manifest.json")]
    if not found:
        raise FileNotFoundError(f"no manifest.json in {directories}")
    rows = None
    for directory in found:
        one = (
            spark.read.schema(MANIFEST_SCHEMA).json(f"{directory}/manifest.json", multiLine=True)
            .select(F.lit(order[directory]).alias("input_order"), F.lit(directory).alias("input_dir"), "*")
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


def listed_shards(manifests: DataFrame) -> DataFrame:
    """``(input_order, input_dir, split, split_idx, path)``, one row per shard a manifest names."""
    carry = [c for c in ("input_order", "input_dir", "dataset") if c in manifests.columns]
    return manifests.select(
        *carry, F.explode(F.map_from_arrays(
            F.array(F.lit("train"), F.lit("val")), F.array(
                F.coalesce("train_shards", F.array().cast("array<string>")),
                F.coalesce("val_shards", F.array().cast("array<string>")))
        )).alias("split", "paths")
    ).select(*carry, "split", F.posexplode("paths").alias("split_idx", "path"))


def has_files(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or glob matches anything."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def shard_files(spark: SparkSession, *patterns: str) -> DataFrame:
    """``(path)`` of the existing shards: Arrow files, or partition directories that hold a Parquet file.

    Only the listing is read, never the content.
    """
    listing = spark.read.format("binaryFile").load(list(patterns)).select("path")
    plain = bare_path(F.col("path"))
    shard = F.when(plain.endswith(".parquet"), F.regexp_replace(plain, "/[^/]+$", "")).otherwise(plain)
    return listing.select(shard.alias("path")).distinct()


def existing_shards(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Listed shards whose file was found."""
    return listed.join(files.withColumnRenamed("path", "_found"), bare_path(F.col("path")) == F.col("_found"), "left_semi")


def missing_shards(listed: DataFrame, files: DataFrame, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Number of listed shards without a file, per dataset."""
    lost = listed.join(files.withColumnRenamed("path", "_found"), bare_path(F.col("path")) == F.col("_found"), "left_anti")
    return lost.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_missing"))


def pool_shards(listed: DataFrame) -> DataFrame:
    """``(split, shards)``: shard lists of many datasets pooled in input order, then shard order."""
    entry = F.struct("input_order", "split_idx", "path")
    pooled = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["path"])
    return listed.groupBy("split").agg(pooled.alias("shards"))


def combine_totals(manifests: DataFrame) -> DataFrame:
    """Summed totals; tokenizer and block size come from the first manifest in input order.

    Totals are those the manifests state; missing shards do not reduce them.
    """
    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name)

    return manifests.agg(
        F.min_by("tokenizer", "input_order").alias("tokenizer"),
        F.min_by("block_size", "input_order").alias("block_size"),
        total("total_blocks"), total("total_tokens"), total("total_docs"),
    )


def combined_manifest(manifests: DataFrame, files: DataFrame, input_dirs: list[str]) -> DataFrame:
    """The pooled manifest as one row."""
    pooled = pool_shards(existing_shards(listed_shards(manifests), files))
    none = F.array().cast("array<string>")
    lists = pooled.agg(
        *[F.coalesce(F.first(F.when(F.col("split") == s, F.col("shards")), ignorenulls=True), none).alias(f"{s}_shards")
          for s in ("train", "val")]
    )
    return combine_totals(manifests).crossJoin(lists).select(  # 1 x 1 rows
        *[
            F.lit("arrow").alias(k) if k == "format" else F.lit("combined").alias(k) if k == "source"
            else F.array(*[F.lit(d) for d in input_dirs]).alias(k) if k == "input_dirs" else F.col(k)
            for k in COMBINED_KEYS
        ]
    )


def dataset_report(manifests: DataFrame) -> DataFrame:
    """Shards per split and tokens of each dataset, with a total row."""
    return manifests.rollup("input_dir").agg(
        F.sum(F.size("train_shards").cast("long")).alias("n_train"), F.sum(F.size("val_shards").cast("long")).alias("n_val"),
        F.sum("total_tokens").alias("total_tokens"),
    )


def running_offset(counts: DataFrame, order: list[str], size: str) -> DataFrame:
    """Add ``offset``: total of ``size`` before each shard. One row per shard file, never per block."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)))
