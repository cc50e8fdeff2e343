"""Streams whose state is a table, streams of the library's own formats, and datasets as Arrow."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

from blockloom.operators.packing import pack_blocks
from blockloom.operators.tokenize import ByteTokenizer
from blockloom.plans.pipeline import Config, documents, write_datasets
from blockloom.sources import arrow_ipc
from blockloom.sources import blocks as B
from blockloom.sources.arrow_ipc import read_arrow
from blockloom.sources.files import ROOT, dataset_folders, read_documents
from blockloom.streaming import ingest as I
from blockloom.streaming.batches import write_packed, write_unique
from blockloom.streaming.pack import flushed_blocks


def arrive(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return I.read_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)


def test_lanes_are_packed_as_the_batch_packer_does(spark, tmp_path):
    rng = random.Random(1)
    batches, number = [], 0
    for size in (5, 1, 40, 3):
        rows = []
        for _ in range(size):
            rows.append((number, rng.choice(["a", "a", "a", "b", None]), "x" * rng.choice([0, 1, 7, 8, 30])))
            number += 1
        batches.append(rng.sample(rows, len(rows)))
    docs = arrive(spark, str(tmp_path / "in"), batches, "doc_id BIGINT, lane STRING, text STRING")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    write_packed(docs, out, mark, 8).awaitTermination()
    blocks = flushed_blocks(spark.read.parquet(out), 8)
    for lane in ("a", "b", ""):
        rows = [(i, t) for batch in batches for i, name, t in sorted(batch, key=lambda r: r[0]) if (name or "") == lane]
        want = pack_blocks(spark.createDataFrame(rows, "ord BIGINT, text STRING"), 8, ByteTokenizer())
        got = blocks.where(F.col("lane") == lane)
        assert [list(r["tokens"]) for r in got.orderBy("block_id").collect()] == [list(r["tokens"]) for r in want.orderBy("block_id").collect()]
    # What arrives later goes on where the last block ended.
    n = spark.read.parquet(out).count()
    write_packed(docs, out, mark, 8).awaitTermination()
    assert spark.read.parquet(out).count() == n


def test_digests_are_never_forgotten(spark, tmp_path):
    batches = [[(1, "aaaa1"), (2, "aaaa2")], [(3, "bbbb1")], [(5, "cccc1"), (4, "cccc0")], [(6, "aaaa3"), (7, "dddd")], [(8, "bbbb2"), (9, "")], [(10, ""), (11, "eeee")]]
    docs = arrive(spark, str(tmp_path / "in"), batches, "doc_id BIGINT, text STRING")
    out, seen, mark = (str(tmp_path / n) for n in ("out", "seen", "mark"))
    for _ in range(2):
        write_unique(docs, out, seen, mark, 4, compact_every=2).awaitTermination()
        assert sorted(r["doc_id"] for r in spark.read.parquet(out).collect()) == [1, 3, 4, 7, 9, 11]
    assert sorted(p.name for p in (tmp_path / "seen").iterdir() if p.name.startswith("upto")) == ["upto=2", "upto=4"]


def test_json_lines_stream_equals_batch(spark, tmp_path):
    rows = [{"id": i, "text": f"text {i} " * (i % 5), "meta": [1, {"x": i}] if i % 2 else "s"} for i in range(40)]
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(2):
        lines = [json.dumps(r) for r in rows[i::2]] + ["", "[1]", "{broken"]
        (folder / f"{i}.jsonl").write_text("\n".join(lines))
    records = I.read_json_stream(spark, str(folder), name_filter="*.jsonl")
    spec = {"type": "field", "field": "text"}
    records = records.select(ROOT, F.expr("try_variant_get(v, '$.id', 'bigint')").alias("id"))
    out = str(tmp_path / "out")
    I.write_available(I.stream_extract(records, spec, ("id",), min_chars=1, root=ROOT), out, str(tmp_path / "mark")).awaitTermination()
    got = sorted((r["id"], r["text"]) for r in spark.read.parquet(out).collect())
    assert got == [(r["id"], r["text"].strip()) for r in rows if r["text"].strip()]
    batch = read_documents(spark, str(folder), spec, min_chars=1)
    assert sorted(r["text"] for r in batch.collect()) == sorted(t for _, t in got)


def test_arrow_stream_takes_each_file_once(spark, tmp_path):
    def write(name, values):
        with pa.OSFile(str(tmp_path / "in" / name), "wb") as sink, pa.ipc.new_file(sink, pa.schema([("x", pa.int64())])) as writer:
            for v in values:
                writer.write_batch(pa.record_batch([pa.array(v, pa.int64())], names=["x"]))

    (tmp_path / "in").mkdir()
    write("b.arrow", [[1, 2], [3]])
    write("c.arrow", [[4]])
    rows = I.read_arrow_stream(spark, str(tmp_path / "in"), "x BIGINT, _file STRING, _block BIGINT, _pos BIGINT", settle_seconds=0)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        I.write_available(rows, out, mark).awaitTermination()
        return sorted((r["x"], r["_block"], r["_pos"]) for r in spark.read.parquet(out).collect())

    assert run() == [(1, 0, 0), (2, 0, 1), (3, 1, 0), (4, 0, 0)]
    assert len(run()) == 4
    write("a.arrow", [[5]])
    assert run()[-1] == (5, 0, 0) and len(run()) == 5


def test_datasets_as_arrow_equal_parquet(spark, tmp_path):
    rows = [(i, f"document {i} " * (i % 9 + 1), ["owner/one", "two", None][i % 3]) for i in range(120)]
    docs = spark.createDataFrame(rows, "ord BIGINT, text STRING, dataset STRING")
    found = {}
    for layout in ("parquet", "arrow", "arrow"):  # the last run replaces the one before
        config = Config(output_dir=str(tmp_path / layout), block_size=16, shard_size=160, val_split=0.2, format=layout)
        manifests = write_datasets(docs, config).orderBy("dataset").collect()
        assert {r["format"] for r in manifests} == {layout}
        found[layout] = []
        for r in manifests:
            # Manifests of one key each read back like any other.
            folder = f"{tmp_path}/{layout}/_manifests/dataset={r['dataset'].replace('/', '%2F')}/manifest.json"
            blocks = [B.read_manifest_blocks(spark, folder, split) for split in ("train", "val")]
            both = blocks[0].unionByName(blocks[1]).select("split", "shard_idx", "row", "input_ids", "labels", "length").collect()
            assert len(both) == r["total_blocks"] and len(r["train_shards"]) > 1
            found[layout].append((r["dataset"], r["total_blocks"], sorted(map(tuple, both))))
    assert found["arrow"] == found["parquet"]
    names = sorted(p.name for p in (tmp_path / "arrow").iterdir())
    assert names == ["_manifests", "dataset=owner%2Fone", "dataset=two", "dataset=unnamed"]


def test_named_dataset_as_input(spark, tmp_path):
    root = tmp_path / "hub"
    for config, name, text in (("b", "x.jsonl", '{"text": "third"}\n{"text": "fourth"}'), ("a", "y.txt", "first\n\nsecond"), ("a", "_hidden.txt", "no")):
        folder = root / "dataset=owner%2Fd" / f"config={config}" / "split=train"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    run = Config(output_dir=str(tmp_path), input=str(root), dataset="owner/d", min_doc_chars=1)
    assert [r["text"] for r in documents(spark, run).orderBy("ord").collect()] == ["first", "second", "third", "fourth"]
    run.dataset_config = "b"
    assert [r["text"] for r in documents(spark, run).orderBy("ord").collect()] == ["third", "fourth"]
    with pytest.raises(FileNotFoundError):
        dataset_folders(spark, str(root), "owner/d", split="test")


def test_arrow_reads_what_is_asked_for(spark, tmp_path):
    schema = pa.schema([("x", pa.int64()), ("wide", pa.string())])
    for name, low in (("a.arrow", 0), ("b.arrow", 100)):
        with pa.OSFile(str(tmp_path / name), "wb") as sink, pa.ipc.new_file(sink, schema) as writer:
            for batch in range(4):
                values = list(range(low + batch * 10, low + batch * 10 + 10))
                writer.write_batch(pa.record_batch([pa.array(values), pa.array([str(v) * 100 for v in values])], schema=schema))
    df = read_arrow(spark, str(tmp_path), columns=["x"])
    assert df.columns == ["x", "_file", "_block", "_pos"] and df.count() == 80
    names = arrow_ipc._open(str(tmp_path / "a.arrow"), df.columns).get_batch(0).schema.names
    assert names == ["x"]
    some = df.where((F.col("_block") >= 1) & (F.col("_block") < 3) & F.col("_file").endswith("b.arrow"))
    assert sorted(r["x"] for r in some.collect()) == list(range(110, 130))
    one = df.select("_file").distinct().orderBy("_file").first()["_file"]
    assert sorted(r["x"] for r in df.where((F.col("_file") == one) & F.col("_block").isin(0, 3)).collect()) == [*range(10), *range(30, 40)]
    assert df.where("_file = 'none'").count() == 0 and df.where("x > 135").count() == 4
    reader = arrow_ipc.ArrowIpcReader(arrow_ipc.list_files([str(tmp_path)], (".arrow",)), df.schema, 1)
    assert len(reader.partitions()) == 8
    list(reader.pushFilters([EqualTo(("_file",), one), GreaterThan(("x",), 5)]))
    assert {p.uri for p in reader.partitions()} == {one}
    list(reader.pushFilters([LessThan(("_block",), 2)]))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 20
