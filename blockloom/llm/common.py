"""Words, row numbers, places in a stream, and pattern matches with their positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.operators.order import bucket_bases, with_bucket

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
FIRST_ORDER = -(1 << 62)
BEFORE = 80


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text of a document; a null text counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def numbered(df: DataFrame) -> DataFrame:
    """Add ``_row``, unique per row. Stable only once the result has been written."""
    return df.withColumn("_row", F.monotonically_increasing_id())


def stream_starts(df: DataFrame, size: str, keys: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> DataFrame:
    """Add ``start``: the total of ``size`` over all rows of the same keys with smaller ``doc_id``.

    Null ids come first. Rows of one id follow the columns of ``ties``. No task sees more than a bucket of ids.
    """
    df = df.withColumn("_ord", F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ORDER)))
    bases = bucket_bases(df, size, keys, "_ord")
    earlier = Window.partitionBy(*keys, "_bucket").orderBy("_ord", *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        with_bucket(df, "_ord").join(bases, [*keys, "_bucket"])
        .withColumn("start", F.col("_base") + F.coalesce(F.sum(size).over(earlier), F.lit(0)))
        .drop("_ord", "_bucket", "_base")
    )


def matches(text: Column, pattern: str, value_group: int = 0) -> Column:
    """All leftmost non-overlapping matches as ``array<struct<width, tail, match, value>>``.

    Each element covers the text from the end of the previous match: ``width`` code points, of which the last are
    the match. A last element without a match holds the rest of the text. ``tail`` is the match with up to ``BEFORE``
    code points before it, ``value`` a group of the pattern. The text is walked once per extracted group, never from each position anew.
    """
    walk = F.lit(f"(?s).*?(?:({pattern})|\\z)")
    part = F.regexp_extract_all(text, walk, F.lit(0))
    match = F.regexp_extract_all(text, walk, F.lit(1))
    value = F.regexp_extract_all(text, walk, F.lit(1 + value_group)) if value_group else match
    zipped = F.arrays_zip(part.alias("part"), match.alias("match"), value.alias("value"))
    return F.transform(zipped, lambda x: F.struct(
        F.length(x["part"]).alias("width"),
        F.right(x["part"], F.least(F.length(x["part"]), F.length(x["match"]) + BEFORE)).alias("tail"),
        x["match"], x["value"],
    ))


NO_MATCHES = "array<struct<width:int,tail:string,match:string,value:string>>"


def matches_if(condition: Column, text: Column, pattern: str, value_group: int = 0) -> Column:
    """``matches`` where a cheap condition holds, else an empty array."""
    return F.when(condition, matches(text, pattern, value_group)).otherwise(F.array().cast(NO_MATCHES))


def placed(found: DataFrame, kinds: list[str]) -> DataFrame:
    """One row per match: ``_row, kind, rank, start, end, match, value, before`` (code points, end exclusive).

    ``found`` has ``_row`` and one array column of ``matches`` per kind. ``before`` holds up to 80 characters
    that stand before the match.
    """
    each = found.select("_row", F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("rank"), F.col(kind).alias("found"))
        for i, kind in enumerate(kinds)
    ])).alias("k"))
    each = each.where(F.size("k.found") > 0).select("_row", "k.kind", "k.rank", F.posexplode("k.found").alias("at", "m"))
    upto = Window.partitionBy("_row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("m.width").cast("long")).over(upto))
    size = F.length("m.match")
    return each.where(size > 0).select(
        "_row", "kind", "rank", (F.col("end") - size).alias("start"), "end", "m.match", "m.value",
        F.left(F.col("m.tail"), F.length("m.tail") - size).alias("before"),
    )


def with_overlaps(spans: DataFrame, base: DataFrame) -> DataFrame:
    """``spans`` with ``_overlaps``: whether a span of ``base`` has a place in common, in the same ``_row``.

    The spans of a row go by start; the furthest end so far and the nearest start still to come decide.
    """
    marked = spans.withColumn("_base", F.lit(False)).unionByName(
        base.select("_row", "start", "end").withColumn("_base", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy("_row").orderBy("start")
    ends = F.max(F.when(F.col("_base"), F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, 0))
    starts = F.min(F.when(F.col("_base"), F.col("start"))).over(order.rangeBetween(0, Window.unboundedFollowing))
    overlaps = F.coalesce(ends > F.col("start"), F.lit(False)) | F.coalesce(starts < F.col("end"), F.lit(False))
    return marked.withColumn("_overlaps", overlaps).where(~F.col("_base")).drop("_base")


def joined_spans(spans: DataFrame, name: str) -> DataFrame:
    """Per ``_row``: ``kind:start:end`` of its spans by start, then rank, comma-joined."""
    listed = F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind")))
    text = F.transform(listed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return spans.groupBy("_row").agg(F.array_join(text, ",").alias(name))
