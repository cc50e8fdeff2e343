"""Corpus and run statistics; every one is a partial aggregation with a tiny result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.fixed import BLOCK_SIZE, PREVIEW_CHARS, SHARD_TOKENS, TOKENS_PER_CHAR


def _total(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def dry_run_stats(
    docs: DataFrame, block_size: int = BLOCK_SIZE, shard_tokens: int = SHARD_TOKENS, text: str = "text"
) -> DataFrame:
    """Documents, characters and the estimated tokens, blocks and shards they would make."""
    totals = docs.agg(F.count(F.lit(1)).alias("n_docs"), _total(F.length(text)).alias("total_chars"))
    return (
        totals
        .withColumn("avg_chars", F.col("total_chars") / F.greatest(F.col("n_docs"), F.lit(1)))
        .withColumn("est_tokens", (F.col("total_chars") * F.lit(TOKENS_PER_CHAR)).cast("long"))
        .withColumn("est_blocks", F.expr(f"est_tokens div {int(block_size)}"))
        .withColumn("est_shards", F.greatest(F.lit(1).cast("long"), F.expr(f"est_tokens div {int(shard_tokens)}")))
    )


def run_stats(counts: DataFrame, block_size: int = BLOCK_SIZE, keys: tuple[str, ...] = ()) -> DataFrame:
    """Documents, tokens seen (EOS included), blocks and tokens written, from token counts ``n_ids`` alone."""
    width = block_size + 1
    totals = counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_docs"), _total(F.col("n_ids") + 1).alias("tokens_seen")
    )
    tail = F.col("tokens_seen") % width
    return (
        totals
        .withColumn("tail_tokens", tail)
        .withColumn("total_blocks", F.expr(f"tokens_seen div {width}") + (tail >= 2).cast("long"))
        .withColumn("total_tokens", F.col("total_blocks") * block_size)
        .withColumn("pad_tokens", F.when(tail >= 2, F.lit(width) - tail).otherwise(F.lit(0)).cast("long"))
    )


def drop_reasons(
    records: DataFrame, passed: Column, text: Column, min_chars: int = 64, max_chars: int = 0
) -> DataFrame:
    """How many records each step drops, in one pass and before duplicates are looked at."""
    n = F.length(text)
    too_long = (n > max_chars) if max_chars else F.lit(False)
    reason = (
        F.when(~F.coalesce(passed, F.lit(False)), "filtered")
        .when(F.coalesce(text, F.lit("")) == "", "no_text")
        .when(n < min_chars, "too_short").when(too_long, "too_long").otherwise("kept")
    )
    return records.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_records"))


def shard_row_counts(rows: DataFrame) -> DataFrame:
    """Rows of every shard, and the position of its first row among all rows of the split."""
    return rows.groupBy("split", "shard_idx").agg(F.count(F.lit(1)).alias("n_rows"))


def mixture_share(counts: DataFrame, dataset: str = "dataset", split: str = "split", size: str = "n_blocks") -> DataFrame:
    """Blocks per dataset and split with subtotals, and each dataset's share of the blocks of its split.

    A uniform draw over all blocks of a split takes from a dataset with exactly this probability.
    """
    per_dataset = counts.groupBy(dataset, split).agg(F.sum(size).alias("n_blocks"))
    report = per_dataset.rollup(split, dataset).agg(F.sum("n_blocks").cast("long").alias("n_blocks"))
    totals = report.where(F.col(dataset).isNull() & F.col(split).isNotNull()).select(
        split, F.col("n_blocks").alias("_split_total")
    )
    return (
        report.join(totals, split, "left")
        .select(
            F.coalesce(split, F.lit("all")).alias(split), F.coalesce(dataset, F.lit("all")).alias(dataset), "n_blocks",
            F.when(F.col(split).isNotNull(), F.col("n_blocks") / F.col("_split_total")).otherwise(F.lit(1.0)).alias("share"),
        )
    )


def preview(docs: DataFrame, n: int, ord_col: str = "ord", text: str = "text") -> DataFrame:
    """The first ``n`` texts in document order, long ones cut and marked."""
    shown = F.when(
        F.length(text) > PREVIEW_CHARS, F.concat(F.substring(text, 1, PREVIEW_CHARS), F.lit("..."))
    ).otherwise(F.col(text))
    return docs.orderBy(ord_col).limit(n).select(ord_col, shown.alias("sample"))
