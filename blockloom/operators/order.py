"""Document order and exclusive running totals without a single-task sort of the documents.

Order is one integer column ``ord``, unique per document (per key) and increasing in document order: any 64-bit numbers,
dense, sparse, hashed or negative. Running totals are taken in levels, so no task ever sees more than one range:

* rows: a window inside ranges of 2^``BUCKET_BITS`` consecutive orders, the buckets,
* buckets: a window inside ranges of 2^``LEVEL_BITS`` consecutive buckets, and so on upwards,
* the last level has at most 2^``LEVEL_BITS`` ranges, as many as 64 bits leave; one window adds them up.

Each level is one small row per range of the level below that holds any order, added up where the rows are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BITS = 8
LEVEL_BITS = 19
#: Levels of ranges above the buckets: 8 + 2 * 19 of 64 bits, and 18 more for the last window.
LEVELS = -(-(64 - BUCKET_BITS) // LEVEL_BITS) - 1


def _before(*partition: str, order: str) -> Window:
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def with_bucket(df: DataFrame, ord_col: str = "ord") -> DataFrame:
    return df.withColumn("_bucket", F.shiftright(F.col(ord_col).cast("long"), BUCKET_BITS))


def bucket_bases(df: DataFrame, size: str, keys: tuple[str, ...] = (), ord_col: str = "ord") -> DataFrame:
    """``(*keys, _bucket, _base)``: total of ``size`` before each bucket.

    Reads only the keys, the order and what ``size`` needs; rows are pre-aggregated before the shuffle.
    """
    level = with_bucket(df, ord_col).groupBy(*keys, F.col("_bucket").alias("_range")).agg(F.sum(size).alias("_sum"))
    levels = []
    for _ in range(LEVELS):
        levels.append(level.withColumn("_above", F.shiftright("_range", LEVEL_BITS)))
        level = levels[-1].groupBy(*keys, F.col("_above").alias("_range")).agg(F.sum("_sum").alias("_sum"))

    def total(*partition: str):
        return F.coalesce(F.sum("_sum").over(_before(*partition, order="_range")), F.lit(0))

    bases = level.select(*keys, "_range", total(*keys).alias("_base"))
    for level in reversed(levels):
        above = bases.withColumnsRenamed({"_range": "_above", "_base": "_above_base"})
        bases = level.join(above, [*keys, "_above"]).select(
            *keys, "_range", (F.col("_above_base") + total(*keys, "_above")).alias("_base"))
    return bases.withColumnRenamed("_range", "_bucket")


def with_start(df: DataFrame, size: str, keys: tuple[str, ...] = (), ord_col: str = "ord") -> DataFrame:
    """Add ``start``: the total of ``size`` over all earlier rows (of the same keys).

    The rows move once, to their bucket; the bucket table joins on the same partitioning.
    """
    bases = bucket_bases(df, size, keys, ord_col)
    inside = F.sum(size).over(_before(*keys, "_bucket", order=ord_col))
    return (
        with_bucket(df, ord_col).join(bases, [*keys, "_bucket"])
        .withColumn("start", F.col("_base") + F.coalesce(inside, F.lit(0)))
        .drop("_bucket", "_base")
    )
