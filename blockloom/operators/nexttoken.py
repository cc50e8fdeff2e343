"""Next-token tables over packed blocks: what training, evaluation and sampling compute, as counts.

All windows run per context over counted continuations, so a partition is at most one row per vocabulary entry
however often the context occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.operators.tokenize import PAD_ID

# Fixed value: a mean loss from here on reports an infinite perplexity.
LOSS_LIMIT = 20.0


def next_pairs(rows: DataFrame, pad_id: int = PAD_ID, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(*keys, prev, next)`` for every position of the training rows, without padding."""
    pair = F.explode(F.arrays_zip("input_ids", "labels"))
    return (
        rows.select(*keys, pair.alias("p"))
        .select(*keys, F.col("p.input_ids").alias("prev"), F.col("p.labels").alias("next"))
        .where((F.col("prev") != pad_id) & (F.col("next") != pad_id))
    )


def bigram_counts(rows: DataFrame, pad_id: int = PAD_ID, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(*keys, prev, next, n)``; pairs are combined before the shuffle."""
    return next_pairs(rows, pad_id, keys).groupBy(*keys, "prev", "next").agg(F.count(F.lit(1)).alias("n"))


def heldout_perplexity(train: DataFrame, val: DataFrame, vocab_size: int) -> DataFrame:
    """``(n_pairs, loss, perplexity)`` of held-out pair counts under add-one smoothed train counts."""
    totals = train.groupBy("prev").agg(F.sum("n").alias("total"))
    scored = (
        val.select("prev", "next", F.col("n").alias("n_val"))
        .join(train.select("prev", "next", "n"), ["prev", "next"], "left").join(totals, "prev", "left")
    )
    share = (F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + F.lit(vocab_size))
    return scored.agg(
        F.sum("n_val").alias("n_pairs"),
        (F.sum(F.col("n_val") * -F.log(share)) / F.sum("n_val")).alias("loss"),
    ).withColumn(
        "perplexity", F.when(F.col("loss") < LOSS_LIMIT, F.exp("loss")).otherwise(F.lit(float("inf")))
    )


def topk_next(scored: DataFrame, k: int) -> DataFrame:
    """Candidates whose score is at least the k-th best of their context; ties at the border stay."""
    best = Window.partitionBy("context").orderBy(F.desc("score"))
    return scored.withColumn("rank", F.rank().over(best)).where(F.col("rank") <= k)


def softmax_share(scored: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Add ``share``: softmax of the scores per context at a temperature."""
    everything = Window.partitionBy("context")
    scaled = scored.withColumn("_s", F.col("score") / F.lit(max(float(temperature), 1e-8)))
    weighted = scaled.withColumn("_w", F.exp(F.col("_s") - F.max("_s").over(everything)))
    return weighted.withColumn("share", F.col("_w") / F.sum("_w").over(everything)).drop("_s", "_w")


def nucleus_next(scored: DataFrame, top_p: float, temperature: float = 1.0) -> DataFrame:
    """Candidates before which at most ``top_p`` of the probability lies, best first, ties by token."""
    before = (
        Window.partitionBy("context").orderBy(F.desc("score"), "token").rowsBetween(Window.unboundedPreceding, -1)
    )
    shares = softmax_share(scored, temperature)
    mass = F.coalesce(F.sum("share").over(before), F.lit(0.0))
    return shares.withColumn("mass_before", mass).where(F.col("mass_before") <= F.lit(float(top_p)))


def repetition_penalty(scored: DataFrame, seen: DataFrame, penalty: float) -> DataFrame:
    """Score after one division (positive) or multiplication (other) per earlier occurrence of the token.

    ``seen`` holds ``(context, token, n_seen)``. Neither step changes the sign, so n steps are one power.
    """
    factor = F.pow(F.lit(float(penalty)), F.coalesce("n_seen", F.lit(0)))
    return scored.join(seen, ["context", "token"], "left").withColumn(
        "penalized", F.when(F.col("score") > 0, F.col("score") / factor).otherwise(F.col("score") * factor)
    )
