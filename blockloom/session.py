"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Arrow batches follow bytes, not rows: one batch never holds 10,000 book-length texts.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
}


def build_session(app: str = "blockloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library assumes; cluster sizing stays with spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    path = spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    path = tempfile.mkdtemp(prefix="blockloom-")
    spark.sparkContext.setCheckpointDir(path)
    return path


#: Bytes of rows that a Python worker takes at once.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds by bytes, whatever the session was started with; results do not depend on it.

    A batch of 10,000 texts as token ids, their cuts and the copies on the way takes some twenty times its bytes.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of a query as soon as the query has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that are made and run inside go when each ends, not when the driver collects garbage.

    Only for results that are written or fetched once: a second run of the same query would have to shuffle anew.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage and keeps column pruning; lost executors cannot lose the table.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with passing_shuffles(spark):
        df.write.parquet(path)
    result = spark.read.schema(df.schema).parquet(path)
    result._materialized_path = path
    return result


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` once everything that reads it has itself been written."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._materialized_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
