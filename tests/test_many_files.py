"""Folders of many small files: tasks follow the bytes, and no task is sent the list of files."""

from __future__ import annotations

import json
import pickle

import numpy as np
import pyarrow as pa
import pytest

from blockloom.sources.arrow_ipc import ArrowIpcSource, read_arrow
from blockloom.sources.blocks import read_dir_blocks
from blockloom.sources.flat_tokens import FlatTokenSource, read_flat_tokens
from blockloom.sources.storage import list_files

FILES, TASKS = 700, 64


def test_flat_files_share_tasks(spark, tmp_path):
    ids = np.arange(FILES * 10, dtype="<u4")
    for i, part in enumerate(ids.reshape(FILES, 10)):
        part.tofile(tmp_path / f"part-{i:010}.bin")
    stream = read_flat_tokens(spark, str(tmp_path), run=7, split_bytes=28)
    assert stream.rdd.getNumPartitions() <= 3 * TASKS
    rows = sorted((r["start"], r["n"], list(r["ids"])) for r in stream.collect())
    assert [t for _, _, run in rows for t in run] == ids.tolist() and all(len(run) == n for _, n, run in rows)
    source = FlatTokenSource({"paths": json.dumps([str(p) for p in sorted(tmp_path.iterdir())]), "run": "7"})
    reader = source.reader(None)
    assert len(reader.partitions()) <= 3 * TASKS and len(pickle.dumps((reader, source))) < 1000


@pytest.mark.parametrize("split", ["train", "val"])
def test_arrow_shards_share_tasks(spark, tmp_path, split):
    schema = pa.schema([("input_ids", pa.list_(pa.int32())), ("labels", pa.list_(pa.int32())), ("length", pa.int32())])
    for name, n in (("train", FILES), ("val", 3)):
        for i in range(n):
            with pa.ipc.new_file(str(tmp_path / f"{name}_shard_{i:05}.arrow"), schema) as writer:
                writer.write_batch(pa.record_batch([pa.array([[i], [i]]), pa.array([[1], [2]]), pa.array([1, 1])], schema=schema))
    n = FILES if split == "train" else 3
    rows = read_dir_blocks(spark, str(tmp_path), split, "arrow")
    found = sorted((r["shard_idx"], r["row"], r["input_ids"][0], r["labels"][0], r["split"]) for r in rows.collect())
    assert found == [(i, k, i, k + 1, split) for i in range(n) for k in range(2)]
    assert rows.rdd.getNumPartitions() <= 2 * TASKS
    names = [str(p) for p in sorted(tmp_path.iterdir())]
    frame = read_arrow(spark, *names, rows="true")
    source = ArrowIpcSource({"paths": json.dumps(names)})
    reader = source.reader(frame.schema)
    assert len(reader.partitions()) <= 2 * TASKS and len(pickle.dumps((reader, source))) < 5000
    assert len(list_files([f"{tmp_path}/{split}_shard_*.arrow"], ())) == n
    with pytest.raises(FileNotFoundError):
        read_dir_blocks(spark, str(tmp_path), "other", "arrow")
