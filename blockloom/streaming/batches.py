"""Streams whose state is a written table: each micro-batch is a batch job over its rows and what earlier ones wrote.

No task holds a lane or a set of keys in memory, so a single lane is packed by as many tasks as its documents need, and a
digest is never forgotten. A micro-batch writes folders of its own number and reads only those of earlier numbers, so a
repeated one gives the same rows again.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from blockloom.operators.dedupe import prefix_key
from blockloom.operators.order import with_start
from blockloom.operators.packing import cut_pieces
from blockloom.operators.tokenize import EOS_ID, ByteTokenizer
from blockloom.session import materialize

FIRST = -(1 << 63)
COMPACT_EVERY = 32


def _run(docs: DataFrame, checkpoint: str, each) -> StreamingQuery:
    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers ``n`` of the finished folders ``name=n``."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    named = (re.fullmatch(rf"{name}=(\d+)", s.getPath().getName()) for s in system.listStatus(root))
    return sorted(
        int(m[1]) for m in named
        if m and system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{m[0]}/_SUCCESS")))


# ---------------------------------------------------------------- packing

def pack_batch(docs: DataFrame, carried: DataFrame | None, block_size: int, eos_id: int = EOS_ID) -> DataFrame:
    """``(lane, block_id, complete, tokens)`` of documents ``(lane, ord, text | ids, n_ids)`` behind what was carried.

    ``carried`` holds the incomplete block of each lane as the last micro-batch wrote it, which also tells how many tokens
    the lane has had. That number goes before the lane's documents as one more size, so the running totals give every
    document its place in the whole lane. All full blocks come out, and for each lane its incomplete one, empty if need be.
    """
    width = block_size + 1
    body = "text" if "text" in docs.columns else "ids"
    sized = docs.select("lane", "ord", (F.col("n_ids") + 1).cast("long").alias("n"), body, F.lit(True).alias("_own"))
    tails = None
    if carried is not None:
        total = F.col("block_id") * width + F.size("tokens")
        before = carried.select(
            "lane", F.lit(FIRST).alias("ord"), total.cast("long").alias("n"), F.lit(None).cast(docs.schema[body].dataType).alias(body),
            F.lit(False).alias("_own"))
        sized = sized.unionByName(before)
        tails = carried.select("lane", "block_id", (F.col("block_id") * width).alias("at"), F.col("tokens").alias("part"))
    totals = sized.groupBy("lane").agg(F.sum("n").alias("_n"))
    end = F.expr(f"_n div {width}")
    pieces = cut_pieces(with_start(sized, "n", ("lane",)).where("_own"), width, ("lane",), eos_id).unionByName(
        totals.select("lane", end.alias("block_id"), F.col("_n").alias("at"), F.array().cast("array<int>").alias("part")))
    if tails is not None:
        pieces = pieces.unionByName(tails)
    ordered = F.sort_array(F.collect_list(F.struct("at", "part")))
    blocks = pieces.groupBy("lane", "block_id").agg(F.flatten(ordered["part"]).alias("tokens"))
    return blocks.select("lane", "block_id", (F.size("tokens") == width).alias("complete"), "tokens")


def write_packed(
    docs: DataFrame, path: str, checkpoint: str, block_size: int, lane: str = "lane", order: str = "doc_id", tokenizer=None,
    eos_id: int = EOS_ID,
) -> StreamingQuery:
    """Pack a stream ``(lane, order, text)`` into ``path/batch_id=…``; ``flushed_blocks`` reads the blocks so far.

    A lane takes its documents by micro-batch, and within one by ``order``, unique there. A null lane is the empty one.
    """
    tokenizer = tokenizer or ByteTokenizer()
    named = F.coalesce(F.col(lane).cast("string"), F.lit(""))

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(named.alias("lane"), F.col(order).cast("long").alias("ord"), "text")
        if hasattr(tokenizer, "count"):
            rows = rows.withColumn("n_ids", tokenizer.count(F.col("text")).cast("long"))
        else:
            rows = tokenizer.encode(rows)
        rows = materialize(rows, "arrived")
        carried = None
        if batch_id:
            carried = spark.read.parquet(f"{path}/batch_id={batch_id - 1}").where(~F.col("complete")).select("lane", "block_id", "tokens")
        pack_batch(rows, carried, block_size, eos_id).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _run(docs, checkpoint, each)


# ---------------------------------------------------------------- dedupe

def _digests(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The digests of all earlier micro-batches: the last compacted table and what came after it."""
    upto = max((n for n in _folders(spark, path, "upto") if n <= batch_id), default=0)
    parts = [f"{path}/upto={upto}"] if upto else []
    parts += [f"{path}/batch_id={n}" for n in _folders(spark, path, "batch_id") if upto <= n < batch_id]
    return spark.read.schema("prefix_md5 STRING").parquet(*parts) if parts else None


def write_unique(
    docs: DataFrame, path: str, digests: str, checkpoint: str, n_chars: int, order: str = "doc_id",
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """One document per prefix digest of a stream ``(order, text, …)``, the first by micro-batch and ``order``, for good.

    The digests of each micro-batch are a table below ``digests``, merged every ``compact_every`` of them. Memory does not
    grow with the stream: a micro-batch looks its own digests up in the table. A copy is dropped however late it comes.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keyed = materialize(batch.withColumn("prefix_md5", prefix_key(F.col("text"), n_chars)), "arrived")
        firsts = keyed.groupBy("prefix_md5").agg(F.min(order).alias(order))
        known = _digests(spark, digests, batch_id)
        if known is not None and batch_id % compact_every == 0:
            known.write.mode("overwrite").parquet(f"{digests}/upto={batch_id}")
            known = spark.read.schema("prefix_md5 STRING").parquet(f"{digests}/upto={batch_id}")
        if known is not None:
            # Only the few digests that came before leave the table.
            seen = known.join(firsts, "prefix_md5", "left_semi")
            firsts = firsts.join(seen, "prefix_md5", "left_anti")
        firsts = materialize(firsts, "firsts")
        same = firsts.withColumnsRenamed({"prefix_md5": "_key", order: "_first"})
        kept = keyed.join(same, (F.col("prefix_md5") == F.col("_key")) & F.col(order).eqNullSafe(F.col("_first")), "left_semi")
        kept.dropDuplicates(["prefix_md5"]).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        firsts.select("prefix_md5").write.mode("overwrite").parquet(f"{digests}/batch_id={batch_id}")

    return _run(docs, checkpoint, each)
