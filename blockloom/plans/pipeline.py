"""The configured end-to-end run: input files to shards and manifest."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.fixed import (
    BLOCK_SIZE, LINES_PER_CHUNK, MAX_CHARS, MIN_CHARS, SEED, SHARD_TOKENS, VAL_FRACTION,
)
from blockloom.operators import manifests as M
from blockloom.operators import packing as P
from blockloom.operators.dedupe import dedupe_prefix
from blockloom.operators.splits import split_blocks, split_position, split_shards
from blockloom.operators.stats import dry_run_stats, preview, run_stats
from blockloom.operators.tokenize import PAD_ID, ByteTokenizer, sequence_estimate
from blockloom.plans.spec import extract, filter_length, resolve_spec
from blockloom.session import discard, materialize
from blockloom.sinks.shards import write_block_shards
from blockloom.sinks.token_files import write_flat_tokens
from blockloom.sources.files import chunks_of, dataset_folders, order_chunks, read_documents, written_lines


# The dataset of documents that name none.
UNNAMED = "unnamed"


@dataclass
class Config:
    """All settings of a run; the defaults are the usual ones."""

    output_dir: str
    input: str | None = None
    dataset: str | None = None  # a dataset landed below ``input``, see ``dataset_folders``
    dataset_config: str | None = None
    dataset_split: str = "train"
    file_type: str | None = None
    preset: str | None = None
    field_map: str | dict | None = None
    text_field: str = "text"
    csv_delimiter: str = ","
    txt_mode: str = "paragraphs"
    tokenizer: object = field(default_factory=ByteTokenizer)
    format: str = "parquet"
    block_size: int = BLOCK_SIZE
    shard_size: int = SHARD_TOKENS
    val_split: float = VAL_FRACTION
    val_shards: int = 0
    compression: str = "zstd"
    no_pack: bool = False
    min_doc_chars: int = MIN_CHARS
    max_doc_chars: int = MAX_CHARS
    dedupe_prefix: int = 0
    seed: int = SEED
    eos_id: int | None = None  # None: the tokenizer's own
    pad_id: int | None = None

    @property
    def spec(self) -> dict:
        return resolve_spec(self.preset, self.field_map, self.text_field)

    def __post_init__(self):
        if self.format not in ("parquet", "arrow", "bin"):
            raise ValueError(f"unknown output format {self.format!r}; known: parquet, arrow, bin")
        if self.eos_id is None:
            self.eos_id = getattr(self.tokenizer, "eos_id", None)
            if self.eos_id is None:
                raise ValueError(f"tokenizer {self.tokenizer.name!r} names no end token: set eos_id")
        if self.pad_id is None:
            own = getattr(self.tokenizer, "pad_id", None)
            self.pad_id = PAD_ID if own is None else own


def _measures(config: Config) -> dict:
    """Columns to keep beside the text, so that later passes over token counts do not read texts."""
    count = getattr(config.tokenizer, "count", None)
    return {"n_ids": count(F.col("text")).cast("long")} if count else {}


def _deduped(docs: DataFrame, config: Config) -> DataFrame:
    """The first document of every prefix; written once, because the packing passes come back to it."""
    return materialize(dedupe_prefix(docs, config.dedupe_prefix), "unique") if config.dedupe_prefix else docs


def documents(spark: SparkSession, config: Config) -> DataFrame:
    """``(ord, text, [n_ids])`` ready for tokenization."""
    path = config.input
    if config.dataset is not None:
        path = dataset_folders(spark, config.input, config.dataset, config.dataset_config, config.dataset_split)
    docs = read_documents(
        spark, path, config.spec, config.file_type, config.txt_mode, config.csv_delimiter,
        min_chars=config.min_doc_chars, max_chars=config.max_doc_chars, extra=_measures(config),
    )
    return _deduped(docs, config)


def prepare(records: DataFrame, config: Config, carry: tuple[str, ...] = ("ord",)) -> DataFrame:
    """The same for records that already are a DataFrame with an order column."""
    docs = filter_length(extract(records, config.spec, carry), config.min_doc_chars, config.max_doc_chars)
    return _deduped(docs.withColumns(_measures(config)), config)


def dry_run(spark: SparkSession, config: Config) -> DataFrame:
    return dry_run_stats(documents(spark, config), config.block_size, config.shard_size)


def show_samples(spark: SparkSession, config: Config, n: int) -> DataFrame:
    return preview(documents(spark, config), n)


def run_pipeline(spark: SparkSession, config: Config) -> DataFrame:
    """Write shards and manifest below ``output_dir``; returns the manifest row as written."""
    return write_corpus(documents(spark, config), config)


def write_corpus(docs: DataFrame, config: Config) -> DataFrame:
    """Tokenize, pack, split and write ``(ord, text)``."""
    spark = docs.sparkSession
    tokenizer = config.tokenizer
    if config.no_pack or not hasattr(tokenizer, "count"):
        docs = materialize(tokenizer.encode(docs.select("ord", "text")), "tokens")
    elif "n_ids" not in docs.columns:
        docs = docs.withColumns(_measures(config))
    totals = materialize(_totals(docs.select("n_ids"), config), "totals")
    per_shard = P.shard_blocks(config.block_size, config.shard_size)
    if config.no_pack:
        blocks = P.assign_shards(P.pad_blocks(P.number_documents(docs), config.block_size, config.pad_id), per_shard)
        blocks = blocks.drop("ord").repartition("shard_idx")
    else:
        blocks = P.pack_blocks(
            docs, config.block_size, tokenizer, eos_id=config.eos_id, pad_id=config.pad_id, blocks_per_shard=per_shard,
        )
    fields = dict(
        format=config.format, tokenizer=tokenizer.name, block_size=config.block_size, vocab_size=tokenizer.vocab_size,
        compression=config.compression if config.format != "bin" else "none", source=config.input, preset=config.preset,
        field_map=config.field_map if isinstance(config.field_map, str) else None,
    )
    if config.format == "bin":
        return _write_bin(blocks, totals, config, fields)
    split = split_shards(M.shard_table(totals, per_shard), config.val_split, config.val_shards, config.seed)
    write_block_shards(blocks, split, config.output_dir, config.format, config.compression)
    listed = split.select("split", "split_idx", M.shard_path(config.output_dir, F.col("split"), F.col("split_idx"), config.format).alias("path"))
    row = M.manifest(listed, totals, **fields)
    M.write_manifest(row, config.output_dir)
    return spark.read.schema(M.MANIFEST_SCHEMA).json(f"{config.output_dir}/manifest.json", multiLine=True)


def _totals(counts: DataFrame, config: Config, keys: tuple[str, ...] = ()) -> DataFrame:
    if not config.no_pack:
        return run_stats(counts, config.block_size, keys)
    # Without packing every document is one block, and its EOS is counted though not written.
    return counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_docs"),
        F.coalesce(F.sum(F.col("n_ids") + 1), F.lit(0)).cast("long").alias("tokens_seen"),
    ).withColumn("total_blocks", F.col("total_docs")).withColumn("total_tokens", F.col("total_blocks") * config.block_size)


def _write_bin(blocks: DataFrame, totals: DataFrame, config: Config, fields: dict) -> DataFrame:
    """Two flat streams; every block loses its last token, which only serves as a label elsewhere."""
    spark = blocks.sparkSession
    rows = materialize(
        split_blocks(blocks, config.val_split, config.seed)
        .select("split", "block_id", F.slice("tokens", F.lit(1), F.size("tokens") - 1).alias("ids")), "blocks",
    )
    for split in ("train", "val"):
        part = rows.where(F.col("split") == split)
        # Order by block; files cover equal ranges of the whole stream, so gaps only make them smaller.
        write_flat_tokens(
            part.withColumn("start", F.col("block_id") * config.block_size), f"{config.output_dir}/{split}.bin"
        )
    written = rows.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("long").alias("total_tokens"))
    listed = spark.range(1).select(F.explode(F.array(
        F.struct(F.lit("train").alias("split"), F.lit(0).alias("split_idx"), F.lit(f"{config.output_dir}/train.bin").alias("path")),
        F.struct(F.lit("val").alias("split"), F.lit(0).alias("split_idx"), F.lit(f"{config.output_dir}/val.bin").alias("path")),
    )).alias("s")).select("s.*")
    row = M.manifest(listed, totals.drop("total_tokens").crossJoin(written), **fields)  # 1 x 1 rows
    M.write_manifest(row, config.output_dir)
    return spark.read.schema(M.MANIFEST_SCHEMA).json(f"{config.output_dir}/manifest.json", multiLine=True)


def pack_datasets(docs: DataFrame, config: Config, dataset: str = "dataset") -> tuple[DataFrame, DataFrame]:
    """Many datasets in one job: ``(blocks, totals)``, each dataset packed into blocks of its own.

    ``docs`` holds ``(dataset, ord, text)``. Running totals are kept per dataset and order range, so a dataset
    with a third of the corpus is spread over tasks like any other. Prefixes are deduplicated within a dataset.
    """
    tokenizer, keys = config.tokenizer, (dataset,)
    per_shard = P.shard_blocks(config.block_size, config.shard_size)
    docs = docs.withColumn(dataset, F.coalesce(F.nullif(F.col(dataset), F.lit("")), F.lit(UNNAMED)))
    docs = dedupe_prefix(docs.select(dataset, "ord", "text"), config.dedupe_prefix, keys=keys)
    # Written once, so that the passes over lengths do not read texts.
    if config.no_pack or not hasattr(tokenizer, "count"):
        docs = materialize(tokenizer.encode(docs), "tokens")
    else:
        docs = materialize(docs.withColumns(_measures(config)), "datasets")
    totals = _totals(docs.select(dataset, "n_ids"), config, keys)
    if config.no_pack:
        padded = P.pad_blocks(P.number_documents(docs, keys=keys), config.block_size, config.pad_id)
        return P.assign_shards(padded, per_shard).drop("ord").repartition(dataset, "shard_idx"), totals
    return P.pack_blocks(docs, config.block_size, tokenizer, keys, config.eos_id, config.pad_id, per_shard), totals


def write_datasets(docs: DataFrame, config: Config, dataset: str = "dataset") -> DataFrame:
    """Pack and write all datasets in one job, with a manifest each; returns one manifest row per dataset.

    ``docs`` holds prepared documents, see ``run_datasets``. Shards are Parquet or Arrow, in a folder per dataset.
    """
    if config.format not in ("parquet", "arrow"):
        raise ValueError(f"datasets are written as parquet or arrow, not {config.format}")
    blocks, totals = pack_datasets(docs, config, dataset)
    totals = materialize(totals, "totals")
    per_shard = P.shard_blocks(config.block_size, config.shard_size)
    split = split_shards(
        M.shard_table(totals, per_shard, (dataset,)), config.val_split, config.val_shards, config.seed, (dataset,)
    )
    write_block_shards(blocks, split, config.output_dir, config.format, config.compression, (dataset,))
    base = F.concat(F.lit(f"{config.output_dir}/{dataset}="), M.directory_value(F.col(dataset)))
    path = F.concat(base, M.shard_path("", F.col("split"), F.col("split_idx"), config.format))
    listed = split.select(dataset, "split", "split_idx", path.alias("path"))
    rows = M.manifest(
        listed, totals, (dataset,), format=config.format, tokenizer=config.tokenizer.name, block_size=config.block_size,
        vocab_size=config.tokenizer.vocab_size, compression=config.compression, source=F.col(dataset),
    )
    rows = materialize(rows, "manifests")
    # Beside the partitions, not among them: the folder stays readable as one table.
    folder = F.concat(F.lit(f"{config.output_dir}/_manifests/{dataset}="), M.directory_value(F.col(dataset)))
    M.write_manifest_files(rows, F.concat(folder, F.lit("/manifest.json")), (dataset,))
    return rows


def run_datasets(spark: SparkSession, inputs: dict[str, Config], config: Config, dataset: str = "dataset") -> DataFrame:
    """Read every dataset by its own settings (input, preset, filters, lengths, dedupe), then write them all in one job
    by the settings of ``config``. Their folders below
    ``_manifests`` can be combined with ``read_manifests``."""
    parts = None
    for name, own in inputs.items():
        part = documents(spark, own).select(F.lit(name).alias(dataset), "ord", "text")
        parts = part if parts is None else parts.unionByName(part)
    return write_datasets(parts, config, dataset)


def run_text(
    spark: SparkSession, paths: list[str], output: str, tokenizer=None, val_split: float = 0.0, add_eos: bool = True,
    chunk_size: int = LINES_PER_CHUNK, block_size: int = BLOCK_SIZE, eos_id: int | None = None,
) -> DataFrame:
    """Text files to one flat token stream, chunk of lines by chunk of lines: ``(total_tokens, n_sequences)``.

    With ``val_split`` the last part of the stream goes to ``output`` with ``_val`` before its extension. Lines and chunks
    are deleted once what reads them is written.
    """
    tokenizer = tokenizer or ByteTokenizer()
    eos = (tokenizer.eos_id if eos_id is None else eos_id) if add_eos else None
    if add_eos and eos is None:
        raise ValueError(f"tokenizer {tokenizer.name!r} names no end token: set eos_id")
    lines = written_lines(spark, *paths)
    chunks = order_chunks(chunks_of(lines, chunk_size))
    if hasattr(tokenizer, "count"):
        docs = materialize(chunks.withColumn("n_ids", tokenizer.count(F.col("text")).cast("long")), "chunks")
    else:
        docs = materialize(tokenizer.encode(chunks), "tokens")
    discard(lines)
    totals = materialize(sequence_estimate(docs, block_size, add_eos), "totals")
    if 0.0 < val_split < 1.0:
        parts = split_position(docs, val_split, totals.first()["total_tokens"], tokenizer, eos)
        stem, dot, extension = output.rpartition(".") if "." in output.rsplit("/", 1)[-1] else (output, "", "")
        write_flat_tokens(parts.where("split = 'train'"), output)
        write_flat_tokens(parts.where("split = 'val'"), f"{stem}_val{dot}{extension}")
    else:
        pieces = P.cut_pieces(P.place_documents(docs, tokenizer, (), eos), 1 << 20, (), eos)
        write_flat_tokens(pieces.select(F.col("at").alias("start"), F.col("part").alias("ids")), output)
    discard(docs)
    return totals
