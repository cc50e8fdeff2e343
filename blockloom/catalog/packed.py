"""Written shards and manifests, read back, pooled and sampled."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from blockloom.catalog.common import (
    BLOCK, BLOCKS_PER_SHARD, SEED, SHARD, VAL, WIDTH, blocks_sql, documents, draw_sql, id_facts, id_facts_sql,
    shards_sql, stream_sql,
)
from blockloom.operators import manifests as M
from blockloom.operators import packing as P
from blockloom.operators.sampling import draw_from_files, draw_from_shards
from blockloom.operators.splits import split_position
from blockloom.operators.stats import run_stats
from blockloom.operators.tokenize import ByteTokenizer, sequence_estimate
from blockloom.plans.pipeline import Config, prepare, write_corpus, write_datasets
from blockloom.session import fresh_path
from blockloom.sinks.token_files import write_flat_tokens as write_flat
from blockloom.sources import blocks as B
from blockloom.sources.flat_tokens import read_flat_tokens

BYTES = ByteTokenizer()
BATCH = 8


def _config(spark, **options) -> Config:
    return Config(output_dir=fresh_path(spark, "corpus"), block_size=BLOCK, shard_size=SHARD, val_split=VAL, seed=SEED, **options)


def _write(spark, sf_dir, **options):
    """The whole documents table as shards; returns settings and manifest."""
    config = _config(spark, **options)
    return config, write_corpus(documents(spark, sf_dir), config)


def _row_facts(rows):
    return rows.select(
        "split", "shard_idx", "row", F.col("length").cast("long").alias("length"), *id_facts("input_ids", "inp"), *id_facts("labels", "lab")
    )


def write_block_shards(spark, sf_dir):
    config, _ = _write(spark, sf_dir)
    train, val = (B.read_dir_blocks(spark, config.output_dir, split) for split in ("train", "val"))
    return _row_facts(train.unionByName(val))


def read_dir_blocks(spark, sf_dir):
    """The same through Arrow IPC shard files."""
    config, _ = _write(spark, sf_dir, format="arrow")
    parts = [
        B.read_blocks(
            spark, split, "arrow", train_dir=config.output_dir, val_dir=config.output_dir, block_size=BLOCK, layout="arrow"
        )
        for split in ("train", "val")
    ]
    return _row_facts(parts[0].unionByName(parts[1]))


def read_manifest_blocks(spark, sf_dir):
    config, _ = _write(spark, sf_dir, compression="lz4")
    parts = [
        B.read_blocks(spark, split, "arrow", manifest=f"{config.output_dir}/manifest.json", block_size=BLOCK)
        for split in ("train", "val")
    ]
    return _row_facts(parts[0].unionByName(parts[1]))


def manifest(spark, sf_dir):
    """The manifest of a filtered, deduplicated run."""
    config = _config(spark, dedupe_prefix=64)
    row = write_corpus(prepare(documents(spark, sf_dir), config), config)
    return row.select(
        "format", "tokenizer", "block_size", "vocab_size", "total_blocks", "total_tokens", "total_docs",
        F.size("train_shards").cast("long").alias("n_train"), F.size("val_shards").cast("long").alias("n_val"),
        "compression", "preset",
    )


def manifest_bin(spark, sf_dir):
    """The manifest of a run with flat output, and what its files hold."""
    config, row = _write(spark, sf_dir, format="bin")
    parts = [
        read_flat_tokens(spark, f"{config.output_dir}/{split}.bin", run=BLOCK).select(F.lit(split).alias("split"), "start", *id_facts("ids", "tok"))
        for split in ("train", "val")
    ]
    head = row.select("format", "total_blocks", "total_tokens", "total_docs", "compression")
    return parts[0].unionByName(parts[1]).join(F.broadcast(head))  # one manifest row


def write_no_pack(spark, sf_dir):
    """One block per document, through shards; rows are one token shorter than the block."""
    config, _ = _write(spark, sf_dir, no_pack=True)
    train, val = (B.read_dir_blocks(spark, config.output_dir, split) for split in ("train", "val"))
    return _row_facts(train.unionByName(val))


def _flat(spark, sf_dir):
    """The documents as flat files; returns the path."""
    path = fresh_path(spark, "flat")
    placed = P.place_documents(documents(spark, sf_dir), BYTES)
    pieces = P.cut_pieces(placed, 1 << 18, (), 1).select(F.col("at").alias("start"), F.col("part").alias("ids"))
    write_flat(pieces, path, tokens_per_file=1 << 18)
    return path


def write_flat_tokens(spark, sf_dir):
    runs = read_flat_tokens(spark, _flat(spark, sf_dir), run=1 << 12)
    return runs.select("start", "n", *id_facts("ids", "tok"))


def scan_flat_tokens(spark, sf_dir):
    """Runs that do not line up with the files."""
    stream = read_flat_tokens(spark, _flat(spark, sf_dir), run=1000, split_bytes=1 << 20)
    return P.cut_stream(stream, BLOCK).select("block_id", *id_facts("tokens", "tok"))


def write_split_flat(spark, sf_dir):
    """Positional split written as two flat streams."""
    docs = documents(spark, sf_dir)
    total = sequence_estimate(docs.select(BYTES.count(F.col("text")).alias("n_ids")), BLOCK).first()["total_tokens"]
    parts, path, results = split_position(docs, VAL, total, BYTES), fresh_path(spark, "flat"), []
    for name, split in (("tokens", "train"), ("tokens_val", "val")):
        write_flat(parts.where(F.col("split") == split), f"{path}/{name}.bin")
        runs = read_flat_tokens(spark, f"{path}/{name}.bin", run=BLOCK)
        results.append(runs.select(F.lit(split).alias("split"), "start", *id_facts("ids", "tok")))
    return results[0].unionByName(results[1])


def shard_row_counts(spark, sf_dir):
    config, _ = _write(spark, sf_dir)
    train, val = (B.block_shards(spark, split, directory=config.output_dir) for split in ("train", "val"))
    counts = train.unionByName(val).select("split", "shard_idx", "n_rows")
    return M.running_offset(counts, ["split", "shard_idx"], "n_rows").withColumnRenamed("offset", "first_row")


def _datasets(spark, sf_dir):
    """All sources written in one job; ``(output folder, manifests)`` with the input order."""
    config = _config(spark)
    docs = documents(spark, sf_dir, F.col("source").alias("dataset"))
    rows = write_datasets(docs, config)
    order = F.dense_rank().over(Window.orderBy("dataset"))
    return config.output_dir, rows.withColumn("input_order", order - 1).withColumn(
        "input_dir", F.concat(F.lit(f"{config.output_dir}/dataset="), M.directory_value(F.col("dataset")))
    )


def _with_lost(manifests):
    """Manifests that also list shards that were lost since."""
    lost = F.concat(F.col("input_dir"), F.lit("/split=train/shard_idx=999999"))
    return manifests.withColumn("train_shards", F.concat("train_shards", F.array(lost)))


def _shard_names(listed):
    return listed.select("dataset", "split", F.regexp_extract("path", r"shard_idx=(\d+)$", 1).cast("long").alias("shard_idx"))


def existing_shards(spark, sf_dir):
    base, manifests = _datasets(spark, sf_dir)
    listed = M.listed_shards(_with_lost(manifests))
    return _shard_names(M.existing_shards(listed, M.shard_files(spark, f"{base}/dataset=*/split=*/*/*.parquet")))


def missing_shards(spark, sf_dir):
    base, manifests = _datasets(spark, sf_dir)
    listed = M.listed_shards(_with_lost(manifests))
    return M.missing_shards(listed, M.shard_files(spark, f"{base}/dataset=*/split=*/*/*.parquet"))


def pool_shards(spark, sf_dir):
    _, manifests = _datasets(spark, sf_dir)
    pooled = M.pool_shards(M.listed_shards(manifests))
    place = F.posexplode("shards").alias("place", "path")
    return pooled.select("split", place).select(
        "split", F.col("place").cast("long").alias("place"),
        F.regexp_extract("path", r"dataset=([^/]+)/", 1).alias("dataset"),
        F.regexp_extract("path", r"shard_idx=(\d+)$", 1).cast("long").alias("shard_idx"),
    )


def combine_totals(spark, sf_dir):
    _, manifests = _datasets(spark, sf_dir)
    return M.combine_totals(manifests)


def combined_manifest(spark, sf_dir):
    """Pooled, written, and read back as one manifest that serves the readers."""
    base, manifests = _datasets(spark, sf_dir)
    files = M.shard_files(spark, f"{base}/dataset=*/split=*/*/*.parquet")
    out = fresh_path(spark, "combined")
    M.write_manifest(M.combined_manifest(_with_lost(manifests), files, [base]), out)
    row = spark.read.schema(M.MANIFEST_SCHEMA + ", input_dirs ARRAY<STRING>").json(f"{out}/manifest.json", multiLine=True)
    return row.select(
        "format", "tokenizer", "block_size", "total_blocks", "total_tokens", "total_docs", "source",
        F.size("train_shards").cast("long").alias("n_train"), F.size("val_shards").cast("long").alias("n_val"),
        F.size("input_dirs").cast("long").alias("n_dirs"),
    )


def dataset_report(spark, sf_dir):
    """Shards and tokens per dataset, and their total."""
    _, manifests = _datasets(spark, sf_dir)
    report = M.dataset_report(manifests.withColumn("input_dir", F.col("dataset")))
    return report.select(F.coalesce("input_dir", F.lit("all")).alias("dataset"), "n_train", "n_val", "total_tokens")


def write_datasets_arrow(spark, sf_dir):
    """All sources packed in one job into Arrow shards, a folder per dataset, read back."""
    config = _config(spark, format="arrow", compression="lz4")
    rows = write_datasets(documents(spark, sf_dir, F.col("source").alias("dataset")), config)
    listed = rows.select(F.explode(F.concat("train_shards", "val_shards")).alias("path")).collect()
    shards = B._read_shards(spark, sorted(r["path"] for r in listed), "arrow")
    return shards.select(
        F.regexp_extract("dataset", "dataset=([^/]+)$", 1).alias("dataset"), "split", "shard_idx", "row",
        F.col("length").cast("long").alias("length"), *id_facts("input_ids", "inp"), *id_facts("labels", "lab"))


def sample_blocks(spark, sf_dir):
    """One epoch of draws over the train shards."""
    config, _ = _write(spark, sf_dir)
    shards = B.block_shards(spark, "train", manifest=f"{config.output_dir}/manifest.json", block_size=BLOCK)
    total = shards.agg(F.sum("n_rows").alias("n")).first()["n"]
    drawn = draw_from_shards(shards, BLOCK, -(-total // BATCH), BATCH, SEED)
    return drawn.select("step", "slot", "row_index", *id_facts("input_ids", "inp"), *id_facts("labels", "lab"))


def sample_windows(spark, sf_dir):
    """As many random windows of the flat stream as it has runs."""
    path = _flat(spark, sf_dir)
    total = sequence_estimate(documents(spark, sf_dir).select(BYTES.count(F.col("text")).alias("n_ids")), BLOCK).first()["total_tokens"]
    drawn = draw_from_files(spark, [path], BLOCK, total // BLOCK // BATCH, BATCH, SEED)
    return drawn.select("step", "slot", "start", *id_facts("input_ids", "inp"), *id_facts("labels", "lab"))


QUERIES = {
    "write_block_shards": write_block_shards,
    "write_no_pack": write_no_pack,
    "write_flat_tokens": write_flat_tokens,
    "write_split_flat": write_split_flat,
    "scan_flat_tokens": scan_flat_tokens,
    "read_manifest_blocks": read_manifest_blocks,
    "read_dir_blocks": read_dir_blocks,
    "manifest": manifest,
    "manifest_bin": manifest_bin,
    "shard_row_counts": shard_row_counts,
    "existing_shards": existing_shards,
    "missing_shards": missing_shards,
    "pool_shards": pool_shards,
    "combine_totals": combine_totals,
    "combined_manifest": combined_manifest,
    "dataset_report": dataset_report,
    "write_datasets_arrow": write_datasets_arrow,
    "sample_blocks": sample_blocks,
    "sample_windows": sample_windows,
}

_STREAM = f"WITH {stream_sql()}"
_SHARDS = f"{_STREAM}, {blocks_sql()}, {shards_sql()}"
_ROWS = """
    q AS (SELECT split, split_idx AS shard_idx, block_id, row_number() OVER (PARTITION BY split, split_idx ORDER BY block_id) - 1 AS row,
                 tokens[:len(tokens) - 1] AS inp, tokens[2:] AS lab
          FROM b JOIN s ON b.block_id // 64 = s.shard_idx)"""
_ROW_FACTS = f"""
    SELECT split, shard_idx, row, CAST(len(list_filter(inp, lambda x: x <> 0)) AS BIGINT) AS length,
           {id_facts_sql('inp', 'inp')}, {id_facts_sql('lab', 'lab')} FROM q"""
_DATASET_SHARDS = f"""
    WITH x AS (SELECT source AS dataset, count(*) AS n_docs, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS n FROM documents GROUP BY source),
    b AS (SELECT dataset, unnest(range(n // {WIDTH} + CASE WHEN n % {WIDTH} >= 2 THEN 1 ELSE 0 END)) AS block_id FROM x),
    {shards_sql('dataset')}"""
_TOTALS = f"""
    x AS (SELECT count(*) AS total_docs, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS n FROM kept),
    y AS (SELECT total_docs, n // {WIDTH} + CASE WHEN n % {WIDTH} >= 2 THEN 1 ELSE 0 END AS total_blocks FROM x),
    z AS (SELECT *, (total_blocks + {BLOCKS_PER_SHARD - 1}) // {BLOCKS_PER_SHARD} AS n_shards FROM y),
    v AS (SELECT *, greatest(1, CAST(floor(n_shards * {VAL}::DOUBLE) AS BIGINT)) AS n_val FROM z)"""
_POSITION_SPLIT = f"""
    {_STREAM},
    c AS (SELECT CAST(floor(count(*) * (1.0::DOUBLE - {VAL}::DOUBLE)) AS BIGINT) AS cut FROM t),
    p AS (SELECT CASE WHEN pos < cut THEN 'train' ELSE 'val' END AS split, CASE WHEN pos < cut THEN pos ELSE pos - cut END AS pos, tok FROM t, c),
    r AS (SELECT split, pos // {BLOCK} * {BLOCK} AS start, list(tok ORDER BY pos) AS tokens FROM p GROUP BY ALL)"""

ORACLES = {
    "write_datasets_arrow": f"""
        WITH {stream_sql("(SELECT source AS dataset, doc_id, text FROM documents)", "dataset")},
        {blocks_sql(partition='dataset')}, {shards_sql('dataset')},
        q AS (SELECT dataset, split, split_idx AS shard_idx, tokens[:len(tokens) - 1] AS inp, tokens[2:] AS lab,
                     row_number() OVER (PARTITION BY dataset, split, split_idx ORDER BY block_id) - 1 AS row
              FROM b JOIN s USING (dataset) WHERE b.block_id // 64 = s.shard_idx)
        SELECT dataset, split, shard_idx, row, CAST(len(list_filter(inp, lambda x: x <> 0)) AS BIGINT) AS length,
               {id_facts_sql('inp', 'inp')}, {id_facts_sql('lab', 'lab')} FROM q""",
    "write_block_shards": f"{_SHARDS}, {_ROWS} {_ROW_FACTS}",
    "read_manifest_blocks": f"{_SHARDS}, {_ROWS} {_ROW_FACTS}",
    "read_dir_blocks": f"{_SHARDS}, {_ROWS} {_ROW_FACTS}",
    "write_no_pack": f"""
        WITH e AS (SELECT doc_id, list_transform(regexp_extract_all(hex(text), '..'), lambda x: ('0x' || x)::INTEGER + 3)[1:{BLOCK}] AS ids FROM documents),
        b AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS block_id, list_concat(ids, list_transform(range({BLOCK} - len(ids)), lambda x: 0)) AS tokens FROM e),
        {shards_sql()}, {_ROWS} {_ROW_FACTS}""",
    "write_flat_tokens": f"""
        {_STREAM}, r AS (SELECT pos // 4096 * 4096 AS start, list(tok ORDER BY pos) AS tokens FROM t GROUP BY 1)
        SELECT start, CAST(len(tokens) AS BIGINT) AS n, {id_facts_sql('tokens', 'tok')} FROM r""",
    "write_split_flat": f"{_POSITION_SPLIT} SELECT split, start, {id_facts_sql('tokens', 'tok')} FROM r",
    "scan_flat_tokens": f"""
        {_STREAM}, r AS (SELECT pos // {BLOCK} AS block_id, list(tok ORDER BY pos) AS tokens FROM t GROUP BY 1)
        SELECT block_id, {id_facts_sql('tokens', 'tok')} FROM r""",
    "manifest": f"""
        WITH kept AS (SELECT doc_id, text FROM documents WHERE length(text) >= 64
                      QUALIFY row_number() OVER (PARTITION BY left(text, 64) ORDER BY doc_id) = 1), {_TOTALS}
        SELECT 'parquet' AS format, 'bytes' AS tokenizer, CAST({BLOCK} AS BIGINT) AS block_size, CAST(259 AS BIGINT) AS vocab_size, total_blocks,
               total_blocks * {BLOCK} AS total_tokens, total_docs, n_shards - n_val AS n_train, n_val, 'zstd' AS compression,
               CAST(NULL AS VARCHAR) AS preset FROM v""",
    "manifest_bin": f"""
        {_STREAM}, {blocks_sql()},
        w AS (SELECT block_id, tokens[:{BLOCK}] AS tokens,
                     CASE WHEN {draw_sql('block_id')} / 4503599627370496.0::DOUBLE < {VAL}::DOUBLE THEN 'val' ELSE 'train' END AS split FROM b),
        m AS (SELECT count(*) AS total_blocks, count(*) * {BLOCK} AS total_tokens FROM w)
        SELECT split, (row_number() OVER (PARTITION BY split ORDER BY block_id) - 1) * {BLOCK} AS start, {id_facts_sql('tokens', 'tok')},
               'bin' AS format, total_blocks, total_tokens, (SELECT count(*) FROM documents) AS total_docs, 'none' AS compression
        FROM w, m""",
    "shard_row_counts": f"""
        {_SHARDS}, n AS (SELECT split, split_idx AS shard_idx, count(*) AS n_rows FROM b JOIN s ON b.block_id // 64 = s.shard_idx GROUP BY 1, 2)
        SELECT split, shard_idx, n_rows, CAST(sum(n_rows) OVER (ORDER BY split, shard_idx) - n_rows AS BIGINT) AS first_row FROM n""",
    "existing_shards": f"{_DATASET_SHARDS} SELECT dataset, split, split_idx AS shard_idx FROM s",
    "missing_shards": "SELECT source AS dataset, CAST(1 AS BIGINT) AS n_missing FROM documents GROUP BY source",
    "pool_shards": f"""
        {_DATASET_SHARDS}
        SELECT split, row_number() OVER (PARTITION BY split ORDER BY dataset, split_idx) - 1 AS place, dataset, split_idx AS shard_idx FROM s""",
    "combine_totals": f"""
        {_DATASET_SHARDS}
        SELECT 'bytes' AS tokenizer, CAST({BLOCK} AS BIGINT) AS block_size, (SELECT count(*) FROM b) AS total_blocks,
               (SELECT count(*) FROM b) * {BLOCK} AS total_tokens, (SELECT count(*) FROM documents) AS total_docs""",
    "combined_manifest": f"""
        {_DATASET_SHARDS}
        SELECT 'arrow' AS format, 'bytes' AS tokenizer, CAST({BLOCK} AS BIGINT) AS block_size, (SELECT count(*) FROM b) AS total_blocks,
               (SELECT count(*) FROM b) * {BLOCK} AS total_tokens, (SELECT count(*) FROM documents) AS total_docs, 'combined' AS source,
               (SELECT count(*) FROM s WHERE split = 'train') AS n_train, (SELECT count(*) FROM s WHERE split = 'val') AS n_val,
               CAST(1 AS BIGINT) AS n_dirs""",
    "dataset_report": f"""
        {_DATASET_SHARDS},
        n AS (SELECT dataset, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val FROM s GROUP BY dataset),
        k AS (SELECT dataset, count(*) * {BLOCK} AS total_tokens FROM b GROUP BY dataset)
        SELECT coalesce(dataset, 'all') AS dataset, CAST(sum(n_train) AS BIGINT) AS n_train, CAST(sum(n_val) AS BIGINT) AS n_val,
               CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM n JOIN k USING (dataset) GROUP BY ROLLUP (dataset)""",
    "sample_blocks": f"""
        {_SHARDS}, {_ROWS},
        k AS (SELECT row_number() OVER (ORDER BY shard_idx, row) - 1 AS row_index, inp, lab FROM q WHERE split = 'train'),
        w AS (SELECT i, {draw_sql('i')} % (SELECT count(*) FROM k) AS row_index
              FROM (SELECT unnest(range(((SELECT count(*) FROM k) + {BATCH - 1}) // {BATCH} * {BATCH})) AS i))
        SELECT i // {BATCH} AS step, i % {BATCH} AS slot, row_index, {id_facts_sql('inp', 'inp')}, {id_facts_sql('lab', 'lab')}
        FROM w JOIN k USING (row_index)""",
    "sample_windows": f"""
        {_STREAM}, r AS (SELECT pos // {BLOCK} AS block_id, list(tok ORDER BY pos) AS tokens FROM t GROUP BY 1),
        n AS (SELECT count(*) AS n FROM t),
        w AS (SELECT i, {draw_sql('i')} % (n - {BLOCK}) AS start FROM (SELECT n, unnest(range(n // {BLOCK} // {BATCH} * {BATCH})) AS i FROM n)),
        x AS (SELECT i, start, start % {BLOCK} AS off, list_concat(f.tokens, g.tokens) AS pair
              FROM w JOIN r f ON f.block_id = start // {BLOCK} LEFT JOIN r g ON g.block_id = start // {BLOCK} + 1),
        y AS (SELECT i, start, pair[off + 1:off + {BLOCK}] AS inp, pair[off + 2:off + {BLOCK} + 1] AS lab FROM x)
        SELECT i // {BATCH} AS step, i % {BATCH} AS slot, start, {id_facts_sql('inp', 'inp')}, {id_facts_sql('lab', 'lab')} FROM y""",
}
