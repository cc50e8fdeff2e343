"""Next-token tables over the packed documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.catalog.common import BLOCK, SEED, VAL, WIDTH, documents, draw_sql, stream_sql, table
from blockloom.operators import nexttoken as N
from blockloom.operators.packing import pack_blocks, shift_labels
from blockloom.operators.splits import split_blocks
from blockloom.operators.tokenize import BYTE_VOCAB_SIZE, ByteTokenizer
from blockloom.session import materialize

K, TOP_P, TEMPERATURE, PENALTY = 5, 0.9, 0.8, 1.001


def _rows(spark, sf_dir):
    return shift_labels(split_blocks(pack_blocks(documents(spark, sf_dir), BLOCK, ByteTokenizer()), VAL, SEED))


def _train_counts(spark, sf_dir):
    return N.bigram_counts(_rows(spark, sf_dir).where(F.col("split") == "train"))


def _scored(spark, sf_dir):
    """Every continuation scored by the logarithm of its count, shifted so that both signs occur."""
    return _train_counts(spark, sf_dir).select(
        F.col("prev").alias("context"), F.col("next").alias("token"), (F.log("n") - 3.0).alias("score")
    )


def _seen(spark, sf_dir):
    """How often each continuation occurs in the benchmark texts."""
    docs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), "text")
    counts = N.bigram_counts(shift_labels(pack_blocks(docs, BLOCK, ByteTokenizer())))
    return counts.select(F.col("prev").alias("context"), F.col("next").alias("token"), F.col("n").alias("n_seen"))


def bigram_counts(spark, sf_dir):
    return _train_counts(spark, sf_dir)


def heldout_perplexity(spark, sf_dir):
    # One pass over the blocks serves both splits; the counts have at most two rows per pair of vocabulary entries.
    counts = materialize(N.bigram_counts(_rows(spark, sf_dir), keys=("split",)), "pairs")
    train, val = (counts.where(F.col("split") == s).drop("split") for s in ("train", "val"))
    result = N.heldout_perplexity(train, val, BYTE_VOCAB_SIZE)
    return result.select("n_pairs", F.round("loss", 6).alias("loss"), F.round("perplexity", 6).alias("perplexity"))


def topk_next(spark, sf_dir):
    return N.topk_next(_scored(spark, sf_dir), K).select("context", "token", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def nucleus_next(spark, sf_dir):
    kept = N.nucleus_next(_scored(spark, sf_dir), TOP_P)
    return kept.select("context", "token", F.round("share", 12).alias("share"), F.round("mass_before", 12).alias("mass_before"))


def softmax_share(spark, sf_dir):
    return N.softmax_share(_scored(spark, sf_dir), TEMPERATURE).select("context", "token", F.round("share", 12).alias("share"))


def repetition_penalty(spark, sf_dir):
    scored = N.repetition_penalty(_scored(spark, sf_dir), _seen(spark, sf_dir), PENALTY)
    return scored.select(
        "context", "token", F.coalesce("n_seen", F.lit(0)).alias("n_seen"), F.round("penalized", 6).alias("penalized")
    )


QUERIES = {
    "bigram_counts": bigram_counts,
    "heldout_perplexity": heldout_perplexity,
    "topk_next": topk_next,
    "nucleus_next": nucleus_next,
    "softmax_share": softmax_share,
    "repetition_penalty": repetition_penalty,
}

_PAIRS = f"""
    WITH {stream_sql()},
    w AS (SELECT pos, tok AS prev, lead(tok) OVER (ORDER BY pos) AS next FROM t),
    p AS (SELECT prev, next, CASE WHEN {draw_sql(f'(pos // {WIDTH})')} / 4503599627370496.0::DOUBLE < {VAL}::DOUBLE THEN 'val' ELSE 'train' END AS split
          FROM w WHERE next IS NOT NULL AND pos // {WIDTH} = (pos + 1) // {WIDTH}),
    c AS (SELECT prev, next, count(*) AS n FROM p WHERE split = 'train' GROUP BY 1, 2),
    sc AS (SELECT prev AS context, next AS token, ln(n) - 3.0::DOUBLE AS score FROM c)"""


def _share_sql(temperature: float) -> str:
    return f"""
    sw AS (SELECT context, token, score, exp(score / {temperature}::DOUBLE - max(score / {temperature}::DOUBLE) OVER (PARTITION BY context)) AS w FROM sc),
    sh AS (SELECT context, token, score, w / sum(w) OVER (PARTITION BY context) AS share FROM sw)"""


_SEEN = stream_sql("(SELECT item_id AS doc_id, text FROM benchmark)")
for _name in ("d", "o", "u", "t"):
    _SEEN = _SEEN.replace(f"\n    {_name} AS ", f"\n    z{_name} AS ").replace(f"FROM {_name})", f"FROM z{_name})").replace(f"FROM {_name}\n", f"FROM z{_name}\n")

ORACLES = {
    "bigram_counts": f"{_PAIRS} SELECT prev, next, n FROM c",
    "heldout_perplexity": f"""
        {_PAIRS},
        m AS (SELECT prev, sum(n) AS total FROM c GROUP BY prev),
        v AS (SELECT prev, next, count(*) AS n_val FROM p WHERE split = 'val' GROUP BY 1, 2),
        l AS (SELECT CAST(sum(n_val) AS BIGINT) AS n_pairs,
                     sum(n_val * -ln((coalesce(n, 0) + 1)::DOUBLE / (coalesce(total, 0) + {BYTE_VOCAB_SIZE}))) / sum(n_val) AS loss
              FROM v LEFT JOIN c USING (prev, next) LEFT JOIN m USING (prev))
        SELECT n_pairs, round(loss, 6) AS loss, round(CASE WHEN loss < 20 THEN exp(loss) ELSE 'inf'::DOUBLE END, 6) AS perplexity FROM l""",
    "topk_next": f"""
        {_PAIRS}
        SELECT context, token, round(score, 6) AS score, rank() OVER (PARTITION BY context ORDER BY score DESC) AS rank
        FROM sc QUALIFY rank <= {K}""",
    "nucleus_next": f"""
        {_PAIRS}, {_share_sql(1.0)},
        g AS (SELECT context, token, share,
                     coalesce(sum(share) OVER (PARTITION BY context ORDER BY score DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mass_before
              FROM sh)
        SELECT context, token, round(share, 12) AS share, round(mass_before, 12) AS mass_before FROM g WHERE mass_before <= {TOP_P}::DOUBLE""",
    "softmax_share": f"{_PAIRS}, {_share_sql(TEMPERATURE)} SELECT context, token, round(share, 12) AS share FROM sh",
    "repetition_penalty": f"""
        {_PAIRS}, {_SEEN},
        zw AS (SELECT pos, tok AS prev, lead(tok) OVER (ORDER BY pos) AS next FROM zt),
        zc AS (SELECT prev AS context, next AS token, count(*) AS n_seen FROM zw
               WHERE next IS NOT NULL AND pos // {WIDTH} = (pos + 1) // {WIDTH} GROUP BY 1, 2)
        SELECT context, token, coalesce(n_seen, 0) AS n_seen,
               round(CASE WHEN score > 0 THEN score / pow({PENALTY}::DOUBLE, coalesce(n_seen, 0)) ELSE score * pow({PENALTY}::DOUBLE, coalesce(n_seen, 0)) END, 6) AS penalized
        FROM sc LEFT JOIN zc USING (context, token)""",
}
