"""Tokenizers, packing, shifting, sharding and splits over the documents table."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from blockloom.catalog.common import (
    BLOCK, BLOCKS_PER_SHARD, SEED, SHARD, VAL, WIDTH, blocks_sql, documents, draw_sql, id_facts, id_facts_sql,
    shards_sql, stream_sql,
)
from blockloom.functions.text import id_digest
from blockloom.operators import packing as P
from blockloom.operators.splits import split_blocks, split_position, split_shards
from blockloom.operators.manifests import shard_table
from blockloom.operators.stats import dry_run_stats, mixture_share, preview, run_stats
from blockloom.operators.tokenize import (
    PIECE_PATTERN, ByteTokenizer, FileTokenizer, VocabTokenizer, build_vocabulary, sequence_estimate,
)
from blockloom.session import fresh_path
from blockloom.sources.storage import locate

VOCAB = 1000
BYTES = ByteTokenizer()


def _doc_ids(tokenized):
    return tokenized.select(
        F.col("ord").alias("doc_id"), F.col("n_ids"), F.get("ids", F.lit(0)).alias("first_id"), id_digest(F.col("ids")).alias("ids_md5"),
    )


def tokenize_bytes(spark, sf_dir):
    return _doc_ids(BYTES.encode(documents(spark, sf_dir)))


def tokenize_vocab(spark, sf_dir):
    docs = documents(spark, sf_dir)
    vocabulary = build_vocabulary(docs, VOCAB)
    return _doc_ids(VocabTokenizer(vocabulary, VOCAB).encode(docs))


def write_vocabulary_file(spark, vocabulary) -> str:
    """A ``tokenizer.json`` for the pieces of a vocabulary table, at most a few thousand rows."""
    ids = {"[PAD]": 0, "[EOS]": 1, "[UNK]": 2, **{r["piece"]: r["id"] for r in vocabulary.collect()}}
    spec = {
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": {"type": "Split", "pattern": {"Regex": PIECE_PATTERN}, "behavior": "Removed", "invert": True},
        "post_processor": None, "decoder": None,
        "model": {"type": "WordLevel", "vocab": ids, "unk_token": "[UNK]"},
    }
    uri = fresh_path(spark, "tokenizer") + ".json"
    system, path = locate(uri)
    with system.open_output_stream(path) as out:
        out.write(json.dumps(spec).encode())
    return uri


def tokenize_hf_file(spark, sf_dir):
    docs = documents(spark, sf_dir)
    path = write_vocabulary_file(spark, build_vocabulary(docs, VOCAB))
    return _doc_ids(FileTokenizer(spark, path).encode(docs))


def _blocks(spark, sf_dir, **options):
    return P.pack_blocks(documents(spark, sf_dir), BLOCK, BYTES, **options)


def pack_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).select("block_id", *id_facts("tokens", "tok"))


def pack_vocab(spark, sf_dir):
    docs = documents(spark, sf_dir)
    blocks = P.pack_blocks(docs, BLOCK, VocabTokenizer(build_vocabulary(docs, VOCAB), VOCAB))
    return blocks.select("block_id", *id_facts("tokens", "tok"))


def pack_tail(spark, sf_dir):
    """The unfinished tail of each source's stream before and after flushing."""
    docs = documents(spark, sf_dir, F.col("source").alias("dataset"))
    placed = P.place_documents(docs, BYTES, ("dataset",))
    short = P.cut_stream(placed, WIDTH, ("dataset",), eos_id=1).where(F.size("tokens") < WIDTH)
    flushed = P.finish_tail(short.withColumn("n_tail", F.size("tokens").cast("long")), BLOCK)
    return flushed.select("dataset", "block_id", "n_tail", *id_facts("tokens", "tok"))


def pad_blocks(spark, sf_dir):
    docs = P.number_documents(BYTES.encode(documents(spark, sf_dir)))
    return P.pad_blocks(docs, BLOCK).select(F.col("ord").alias("doc_id"), "block_id", *id_facts("tokens", "tok"))


def shift_labels(spark, sf_dir):
    rows = P.shift_labels(_blocks(spark, sf_dir))
    return rows.select("block_id", *id_facts("input_ids", "inp"), *id_facts("labels", "lab"), F.col("length").cast("long").alias("length"))


def assign_shards(spark, sf_dir):
    blocks = P.assign_shards(_blocks(spark, sf_dir), P.shard_blocks(BLOCK, SHARD))
    return blocks.groupBy("shard_idx").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.min("block_id").alias("first_block"), F.max("block_id").alias("last_block")
    )


def _counts(spark, sf_dir, *carry):
    return documents(spark, sf_dir, *carry).select(*[c if isinstance(c, str) else "dataset" for c in carry], BYTES.count(F.col("text")).cast("long").alias("n_ids"))


def split_shards_query(spark, sf_dir):
    totals = run_stats(_counts(spark, sf_dir), BLOCK)
    return split_shards(shard_table(totals, BLOCKS_PER_SHARD), VAL, 0, SEED)


def split_blocks_query(spark, sf_dir):
    return split_blocks(_blocks(spark, sf_dir), VAL, SEED).select("block_id", "split", *id_facts("tokens", "tok"))


def split_position_query(spark, sf_dir):
    docs = documents(spark, sf_dir)
    total = sequence_estimate(docs.select(BYTES.count(F.col("text")).alias("n_ids")), BLOCK).first()["total_tokens"]
    parts = split_position(docs, VAL, total, BYTES)
    # The stream itself is too long for one value: its runs of BLOCK tokens stand for it.
    runs = P.cut_stream(parts.withColumn("n", F.size("ids").cast("long")), BLOCK, ("split",))
    return runs.select("split", "block_id", *id_facts("tokens", "tok"))


def dry_run_query(spark, sf_dir):
    stats = dry_run_stats(documents(spark, sf_dir), BLOCK, SHARD)
    return stats.withColumn("avg_chars", F.round("avg_chars", 6))


def run_stats_query(spark, sf_dir):
    return run_stats(_counts(spark, sf_dir, "source"), BLOCK, ("source",))


def sequence_estimate_query(spark, sf_dir):
    return sequence_estimate(_counts(spark, sf_dir), BLOCK)


def preview_query(spark, sf_dir):
    return preview(documents(spark, sf_dir), 20).select(F.col("ord").alias("doc_id"), "sample")


def mixture_query(spark, sf_dir):
    counts = run_stats(_counts(spark, sf_dir, "source"), BLOCK, ("source",))
    shards = split_shards(shard_table(counts, 4, ("source",)), VAL, 0, SEED, ("source",))
    per_shard = shards.join(counts.select("source", "total_blocks"), "source").select(
        F.col("source").alias("dataset"), "split",
        F.least(F.lit(4).cast("long"), F.col("total_blocks") - F.col("shard_idx") * 4).alias("n_blocks"),
    )
    return mixture_share(per_shard).withColumn("share", F.round("share", 12))


def multi_dataset_pack(spark, sf_dir):
    blocks = P.pack_blocks(
        documents(spark, sf_dir, F.col("source").alias("dataset")), BLOCK, BYTES, ("dataset",), blocks_per_shard=BLOCKS_PER_SHARD
    )
    return blocks.select("dataset", "shard_idx", "block_id", *id_facts("tokens", "tok"))


def blocks_per_source(spark, sf_dir):
    """How many training blocks each source yields, how they split, and with how much padding."""
    docs = documents(spark, sf_dir, F.col("source").alias("dataset"))
    rows = P.shift_labels(P.pack_blocks(docs, BLOCK, BYTES, ("dataset",)))
    return rows.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum("length").cast("long").alias("n_inputs"),
        F.sum(F.lit(BLOCK) - F.col("length")).cast("long").alias("n_padding"),
    )


QUERIES = {
    "tokenize_bytes": tokenize_bytes,
    "tokenize_vocab": tokenize_vocab,
    "tokenize_hf_file": tokenize_hf_file,
    "pack_blocks": pack_blocks,
    "pack_vocab": pack_vocab,
    "pack_tail": pack_tail,
    "pad_blocks": pad_blocks,
    "shift_labels": shift_labels,
    "assign_shards": assign_shards,
    "split_shards": split_shards_query,
    "split_blocks": split_blocks_query,
    "split_position": split_position_query,
    "dry_run_stats": dry_run_query,
    "run_stats": run_stats_query,
    "sequence_estimate": sequence_estimate_query,
    "preview": preview_query,
    "mixture_share": mixture_query,
    "multi_dataset_pack": multi_dataset_pack,
    "blocks_per_source": blocks_per_source,
}

_STREAM = f"WITH {stream_sql()}"
_BY_SOURCE = f"WITH src AS (SELECT source AS dataset, doc_id, text FROM documents), {stream_sql('src', 'dataset')}"

_VOCAB_DOCS = f"""
    pc AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i
           FROM (SELECT doc_id, regexp_extract_all(text, '{PIECE_PATTERN}') AS p FROM documents)),
    vc AS (SELECT piece, row_number() OVER (ORDER BY n DESC, piece) + 2 AS id
           FROM (SELECT piece, count(*) AS n FROM pc GROUP BY piece) ORDER BY n DESC, piece LIMIT {VOCAB}),
    vi AS (SELECT doc_id, i, CAST(coalesce(id, 2) AS INTEGER) AS id FROM pc LEFT JOIN vc USING (piece)),
    ve AS (SELECT d.doc_id, coalesce(ids, []) AS ids FROM documents d
           LEFT JOIN (SELECT doc_id, list(id ORDER BY i) AS ids FROM vi GROUP BY doc_id) USING (doc_id))"""

_DOC_IDS = """SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_ids, ids[1] AS first_id,
                     md5(array_to_string(ids::VARCHAR[], ' ')) AS ids_md5"""

_SOURCE_COUNTS = f"""
    rs AS (SELECT source, count(*) AS total_docs, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS tokens_seen
           FROM documents GROUP BY source),
    rb AS (SELECT *, tokens_seen % {WIDTH} AS tail_tokens,
                  tokens_seen // {WIDTH} + CASE WHEN tokens_seen % {WIDTH} >= 2 THEN 1 ELSE 0 END AS total_blocks FROM rs)"""

ORACLES = {
    "tokenize_bytes": f"""
        WITH e AS (SELECT doc_id, list_transform(regexp_extract_all(hex(text), '..'), lambda x: ('0x' || x)::INTEGER + 3) AS ids
                   FROM documents)
        {_DOC_IDS} FROM e""",
    "tokenize_vocab": f"WITH {_VOCAB_DOCS} {_DOC_IDS} FROM ve",
    "tokenize_hf_file": f"WITH {_VOCAB_DOCS} {_DOC_IDS} FROM ve",
    "pack_blocks": f"{_STREAM}, {blocks_sql()} SELECT block_id, {id_facts_sql('tokens', 'tok')} FROM b",
    "pack_vocab": f"""
        WITH {_VOCAB_DOCS},
        o AS (SELECT doc_id, list_append(ids, 1) AS l, SUM(len(ids) + 1) OVER (ORDER BY doc_id) - len(ids) - 1 AS start FROM ve),
        t AS (SELECT CAST(start + generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS tok FROM o),
        {blocks_sql()} SELECT block_id, {id_facts_sql('tokens', 'tok')} FROM b""",
    "pack_tail": f"""
        {_BY_SOURCE}, {blocks_sql(partition='dataset')}
        SELECT dataset, block_id, CAST(len(r.tokens) AS BIGINT) AS n_tail, {id_facts_sql('b.tokens', 'tok')}
        FROM r JOIN b USING (dataset, block_id) WHERE len(r.tokens) < {WIDTH}""",
    "pad_blocks": f"""
        WITH e AS (SELECT doc_id, list_transform(regexp_extract_all(hex(text), '..'), lambda x: ('0x' || x)::INTEGER + 3)[1:{BLOCK}] AS ids
                   FROM documents),
             f AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS block_id,
                          list_concat(ids, list_transform(range({BLOCK} - len(ids)), lambda x: 0)) AS tokens FROM e)
        SELECT doc_id, block_id, {id_facts_sql('tokens', 'tok')} FROM f""",
    "shift_labels": f"""
        {_STREAM}, {blocks_sql()},
        q AS (SELECT block_id, tokens[:{BLOCK}] AS inp, tokens[2:] AS lab FROM b)
        SELECT block_id, {id_facts_sql('inp', 'inp')}, {id_facts_sql('lab', 'lab')},
               CAST(len(list_filter(inp, lambda x: x <> 0)) AS BIGINT) AS length FROM q""",
    "assign_shards": f"""
        {_STREAM}, {blocks_sql()}
        SELECT block_id // {BLOCKS_PER_SHARD} AS shard_idx, count(*) AS n_blocks, min(block_id) AS first_block,
               max(block_id) AS last_block FROM b GROUP BY 1""",
    "split_shards": f"{_STREAM}, {blocks_sql()}, {shards_sql()} SELECT shard_idx, split, split_idx FROM s",
    "split_blocks": f"""
        {_STREAM}, {blocks_sql()}
        SELECT block_id, CASE WHEN {draw_sql('block_id')} / 4503599627370496.0::DOUBLE < {VAL}::DOUBLE THEN 'val' ELSE 'train' END AS split,
               {id_facts_sql('tokens', 'tok')} FROM b""",
    "split_position": f"""
        {_STREAM},
        c AS (SELECT CAST(floor(count(*) * (1.0::DOUBLE - {VAL}::DOUBLE)) AS BIGINT) AS cut FROM t),
        p AS (SELECT CASE WHEN pos < cut THEN 'train' ELSE 'val' END AS split,
                     CASE WHEN pos < cut THEN pos ELSE pos - cut END AS pos, tok FROM t, c),
        r AS (SELECT split, pos // {BLOCK} AS block_id, list(tok ORDER BY pos) AS tokens FROM p GROUP BY ALL)
        SELECT split, block_id, {id_facts_sql('tokens', 'tok')} FROM r""",
    "dry_run_stats": f"""
        WITH x AS (SELECT count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS total_chars FROM documents),
             y AS (SELECT *, CAST(floor(total_chars * 0.25::DOUBLE) AS BIGINT) AS est_tokens FROM x)
        SELECT n_docs, total_chars, round(total_chars / greatest(n_docs, 1), 6) AS avg_chars, est_tokens,
               est_tokens // {BLOCK} AS est_blocks, greatest(1, est_tokens // {SHARD}) AS est_shards FROM y""",
    "run_stats": f"""
        WITH {_SOURCE_COUNTS}
        SELECT source, total_docs, tokens_seen, tail_tokens, total_blocks, total_blocks * {BLOCK} AS total_tokens,
               CASE WHEN tail_tokens >= 2 THEN {WIDTH} - tail_tokens ELSE 0 END AS pad_tokens FROM rb""",
    "sequence_estimate": f"""
        WITH x AS (SELECT CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS total_tokens FROM documents)
        SELECT total_tokens, total_tokens // {BLOCK} AS n_sequences FROM x""",
    "preview": """
        SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS sample
        FROM documents ORDER BY doc_id LIMIT 20""",
    "mixture_share": f"""
        WITH {_SOURCE_COUNTS},
        b AS (SELECT source, unnest(range(total_blocks)) AS block_id FROM rb),
        {shards_sql('source').replace(f'// {BLOCKS_PER_SHARD}', '// 4')},
        n AS (SELECT split, b.source AS dataset, count(*) AS n_blocks
              FROM b JOIN s ON b.source = s.source AND b.block_id // 4 = s.shard_idx GROUP BY ROLLUP (split, b.source))
        SELECT coalesce(split, 'all') AS split, coalesce(dataset, 'all') AS dataset, n_blocks,
               CASE WHEN split IS NULL THEN 1.0
                    ELSE round(n_blocks / sum(CASE WHEN dataset IS NOT NULL THEN n_blocks END) OVER (PARTITION BY split), 12) END AS share
        FROM n""",
    "multi_dataset_pack": f"""
        {_BY_SOURCE}, {blocks_sql(partition='dataset')}
        SELECT dataset, block_id // {BLOCKS_PER_SHARD} AS shard_idx, block_id, {id_facts_sql('tokens', 'tok')} FROM b""",
    "blocks_per_source": f"""
        {_BY_SOURCE}, {blocks_sql(partition='dataset')},
        q AS (SELECT dataset, len(list_filter(tokens[:{BLOCK}], lambda x: x <> 0)) AS n FROM b)
        SELECT dataset, count(*) AS n_blocks, CAST(sum(n) AS BIGINT) AS n_inputs,
               CAST(sum({BLOCK} - n) AS BIGINT) AS n_padding FROM q GROUP BY dataset""",
}
