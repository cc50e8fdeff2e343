"""Keep the first document of every text prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefix_key(text: Column, n_chars: int) -> Column:
    return F.md5(F.substring(text, 1, n_chars).cast("binary"))


def dedupe_prefix(
    docs: DataFrame, n_chars: int, ord_col: str = "ord", text: str = "text", keys: tuple[str, ...] = ()
) -> DataFrame:
    """One document per md5 of the first ``n_chars`` code points, the one with the lowest order; 0 keeps all.

    With ``keys`` every dataset is deduplicated for itself; the order is unique within the keys only.

    The groups hold (digest, lowest order) only and are combined before the shuffle, so a prefix shared by a
    third of the corpus is one small row per task. Texts move at most once, spread evenly by their unique order.
    """
    if n_chars <= 0:
        return docs
    firsts = (
        docs.groupBy(*keys, prefix_key(F.col(text), n_chars).alias("_key"))
        .agg(F.min(ord_col).alias(ord_col)).select(*keys, ord_col)
    )
    return docs.join(firsts, [*keys, ord_col], "left_semi")
