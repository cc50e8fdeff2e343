"""Continuous ingest: extraction, prefix dedupe, live counters and restartable writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from blockloom.operators.dedupe import prefix_key
from blockloom.plans.spec import extract, filter_length
from blockloom.sources.arrow_ipc import ArrowIpcSource
from blockloom.sources.files import json_objects
from blockloom.sources.storage import register_source


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet", files_per_trigger: int = 1000,
    name_filter: str | None = None, **options,
) -> DataFrame:
    """A folder as a stream of new files."""
    reader = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.options(**options).load(path)


def read_json_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000, name_filter: str | None = None) -> DataFrame:
    """JSON Lines files as a stream of objects of any shape, the column ``v`` of the batch reader."""
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return json_objects(reader.load(path))


def read_arrow_stream(spark: SparkSession, path: str, schema: T.StructType | str, settle_seconds: float = 2.0) -> DataFrame:
    """Arrow IPC files of a folder as a stream of new files, with the order columns of the batch reader.

    A file is taken once it has not changed for ``settle_seconds``; see ``sources.arrow_ipc``.
    """
    register_source(spark, ArrowIpcSource)
    reader = spark.readStream.format("arrow_ipc").option("path", path).option("settle_seconds", str(settle_seconds))
    return reader.schema(schema).load()


def stream_extract(
    records: DataFrame, spec: dict, carry: tuple[str, ...], min_chars: int = 64, max_chars: int = 0, root: str | None = None,
) -> DataFrame:
    """The batch expressions, unchanged, on a stream."""
    return filter_length(extract(records, spec, carry, root=root), min_chars, max_chars)


def stream_dedupe(docs: DataFrame, n_chars: int, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """One document per prefix digest; the first to arrive stays.

    The state holds a 32-character digest per distinct prefix. With ``event_time`` a digest is forgotten ``delay``
    after its time, which bounds the state, and a copy that arrives later than that is kept again.
    """
    keyed = docs.withColumn("prefix_md5", prefix_key(F.col("text"), n_chars))
    if event_time is None:
        return keyed.dropDuplicates(["prefix_md5"])
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["prefix_md5"])


def stream_stats(docs: DataFrame, key: str = "source") -> DataFrame:
    """Live documents and byte tokens (EOS included) per key, for update or complete mode."""
    return docs.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.octet_length("text") + 1).cast("long").alias("tokens_seen")
    )


def write_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived, append it as Parquet exactly once, and stop."""
    return (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def write_resumable(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces its own partition, so a repeated batch adds no rows."""
    def overwrite(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        df.writeStream.foreachBatch(overwrite).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def write_latest(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Complete-mode aggregates: each trigger replaces the small result table."""
    def overwrite(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return (
        df.writeStream.outputMode("complete").foreachBatch(overwrite).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
