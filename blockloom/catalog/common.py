"""Inputs and SQL fragments shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.fixed import WHITESPACE
from blockloom.functions.text import id_digest

BLOCK = 1024
WIDTH = BLOCK + 1
SHARD = 64 * BLOCK
BLOCKS_PER_SHARD = 64
SEED = 42
VAL = 0.05


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *carry: str) -> DataFrame:
    """``(ord, text, …)`` of the documents table."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text", *carry)


def text_facts(text: str = "text") -> list[Column]:
    """Scalars that stand for a text in a result."""
    return [F.length(text).cast("long").alias("n_chars"), F.md5(F.col(text).cast("binary")).alias("text_md5")]


TEXT_FACTS = "CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5"


def id_facts(ids: str, prefix: str) -> list[Column]:
    """Scalars that stand for an id list in a result."""
    return [
        F.size(ids).cast("long").alias(f"{prefix}_n"), F.get(ids, F.lit(0)).alias(f"{prefix}_first"),
        F.get(ids, F.size(ids) - 1).alias(f"{prefix}_last"), id_digest(F.col(ids)).alias(f"{prefix}_md5"),
    ]


def id_facts_sql(ids: str, prefix: str) -> str:
    return (
        f"CAST(len({ids}) AS BIGINT) AS {prefix}_n, {ids}[1] AS {prefix}_first, {ids}[-1] AS {prefix}_last, "
        f"md5(array_to_string({ids}::VARCHAR[], ' ')) AS {prefix}_md5"
    )


# Outer Unicode whitespace removed, as SQL.
_SPACES = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def strip_sql(expression: str) -> str:
    return f"trim({expression}, {_SPACES})"


def draw_sql(key: str, seed: int = SEED) -> str:
    """52-bit draw of ``seed:key``."""
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 13))::BIGINT"


def stream_sql(source: str = "documents", partition: str = "", text: str = "text") -> str:
    """CTEs: ``o`` places documents in the stream, ``t`` is the stream, one row per token with its ``pos``.

    ``source`` is a relation with ``ord``-able ``doc_id`` and ``text``.
    """
    over = f"PARTITION BY {partition} ORDER BY doc_id" if partition else "ORDER BY doc_id"
    carry = f"{partition}, " if partition else ""
    return f"""
    d AS (SELECT {carry}doc_id, list_append(regexp_extract_all(hex({text}), '..'), 'EOS') AS l FROM {source}),
    o AS (SELECT {carry}doc_id, l, SUM(len(l)) OVER ({over}) - len(l) AS start FROM d),
    u AS (SELECT {carry}doc_id, start, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM o),
    t AS (SELECT {carry}CAST(start + i AS BIGINT) AS pos,
                 CASE WHEN x = 'EOS' THEN 1 ELSE ('0x' || x)::INTEGER + 3 END AS tok FROM u)"""


def runs_sql(width: int, partition: str = "", name: str = "r") -> str:
    """CTE of stream runs of ``width`` tokens; the last one may be short."""
    carry = f"{partition}, " if partition else ""
    return f"{name} AS (SELECT {carry}pos // {width} AS block_id, list(tok ORDER BY pos) AS tokens FROM t GROUP BY ALL)"


def blocks_sql(width: int = WIDTH, partition: str = "") -> str:
    """CTEs up to ``b``: finished blocks, the tail padded or dropped."""
    carry = f"{partition}, " if partition else ""
    return f"""{runs_sql(width, partition)},
    b AS (SELECT {carry}block_id,
                 list_concat(tokens, list_transform(range({width} - len(tokens)), lambda x: 0)) AS tokens
          FROM r WHERE len(tokens) >= 2)"""


def shards_sql(partition: str = "") -> str:
    """CTE ``s``: split and number of every shard; needs ``b``."""
    carry = f"{partition}, " if partition else ""
    by = f"PARTITION BY {partition}" if partition else ""
    key = f"{partition} || ':' || shard_idx" if partition else "shard_idx"
    return f"""
    si AS (SELECT DISTINCT {carry}block_id // {BLOCKS_PER_SHARD} AS shard_idx FROM b),
    sr AS (SELECT {carry}shard_idx, row_number() OVER ({by} ORDER BY md5('{SEED}:' || {key}), shard_idx) AS rk,
                  greatest(1, CAST(floor(count(*) OVER ({by}) * {VAL}::DOUBLE) AS BIGINT)) AS n_val FROM si),
    s AS (SELECT {carry}shard_idx, CASE WHEN rk <= n_val THEN 'val' ELSE 'train' END AS split,
                 CASE WHEN rk <= n_val THEN rk - 1 ELSE rk - 1 - n_val END AS split_idx FROM sr)"""
