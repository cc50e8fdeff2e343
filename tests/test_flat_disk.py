"""Flat files: what moves to them, and what is left on disk when they are written."""

from __future__ import annotations

import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from blockloom.plans.pipeline import run_text
from blockloom.sinks import token_files
from blockloom.sources.flat_tokens import read_flat_tokens


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().endswith(".data")}


def test_ids_move_in_few_bytes_and_leave_no_shuffle(spark, tmp_path, monkeypatch):
    moved, write = [], token_files.write_token_files
    monkeypatch.setattr(token_files, "write_token_files", lambda df, *a: (moved.append(df), write(df, *a))[1])
    placed = spark.range(0, 3000, 1, 3).select(
        (F.col("id") * 50).alias("start"), F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.pmod(F.col("id") * 50 + i, F.lit(250)).cast("int")).alias("ids"))
    before = shuffle_files(spark)
    token_files.write_flat_tokens(placed, str(tmp_path / "flat"), tokens_per_file=10_000)
    until = time.time() + 20  # Spark deletes them in the background
    while not shuffle_files(spark) <= before and time.time() < until:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert moved[0].agg(F.sum(F.octet_length("data"))).first()[0] == 150_000
    found = np.concatenate([np.fromfile(f, "<u4") for f in sorted(Path(tmp_path / "flat").glob("*.bin"))])
    assert np.array_equal(found, np.arange(150_000) % 250)


def test_ids_of_any_size_keep_their_value(spark, tmp_path):
    lists = [[3, 247], [255], [], None, [256, 1], [65535] * 3, [65536], [0, 2**31 - 1, 7]] * 30
    starts = np.cumsum([0, *(len(x or []) for x in lists)]).tolist()
    rows = spark.createDataFrame(list(zip(starts, lists)), "start long, ids array<int>").repartition(5)
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        token_files.write_flat_tokens(rows, str(tmp_path / "flat"), tokens_per_file=64)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    found = read_flat_tokens(spark, str(tmp_path / "flat")).orderBy("start").collect()
    assert [i for r in found for i in r["ids"]] == [i for x in lists for i in x or []]


def test_a_run_over_text_leaves_no_lines_and_chunks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n\nthree\nfour")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = {p.name for p in shared.iterdir()}
    totals = run_text(spark, [str(tmp_path / "a.txt")], str(tmp_path / "out.bin"), val_split=0.5, chunk_size=2)
    assert not [p for p in shared.iterdir() if p.name not in before and p.name.startswith(("lines-", "chunks-"))]
    assert totals.first()["total_tokens"] == 20
    found = [i for name in ("out.bin", "out_val.bin") for f in sorted((tmp_path / name).glob("*.bin")) for i in np.fromfile(f, "<u4").tolist()]
    assert found == [i for chunk in (b"one\ntwo", b"\nthree", b"four") for i in [*(b + 3 for b in chunk), 1]]
