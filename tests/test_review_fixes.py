"""Records and shards of sizes and shapes that small fixtures do not reach."""

from __future__ import annotations

import io
import json
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.operators import manifests as M
from blockloom.operators.tokenize import FileTokenizer
from blockloom.plans.filters import filter_records
from blockloom.plans.pipeline import Config, run_datasets, write_datasets
from blockloom.sources import files
from blockloom.sources.arrow_ipc import read_arrow
from blockloom.sources.storage import locate


def test_json_lines_lose_nothing(spark, tmp_path):
    long = "x" * (21 << 20)
    path = tmp_path / "a.jsonl"
    path.write_text('{"t": "a", "t": "b"}\n{"t": "c", "s": NaN}\nbroken {\n\n[1]\n{"t": "' + long + '"}\n')
    rows = files.read_jsonl(spark, str(path))
    found = [r["t"] for r in rows.select(F.length(F.try_variant_get(files.ROOT, "$.t", "string")).alias("t")).collect()]
    assert sorted(found) == [1, 1, len(long)]


def test_rows_of_uneven_record_batches(spark, tmp_path):
    schema = pa.schema([("x", pa.int64())])
    path = str(tmp_path / "a.arrow")
    with pa.ipc.new_file(path, schema) as writer:
        at = 0
        for n in (3, 10_000, 1, 0, 57):
            writer.write_batch(pa.record_batch([pa.array(range(at, at + n), pa.int64())], schema=schema))
            at += n
    rows = read_arrow(spark, path, rows="true", split_bytes=1000)
    assert rows.where("x <> _row").count() == 0 and rows.count() == at


def test_headers_are_read_whole():
    wide = ",".join(f"column_{i}" for i in range(20_000))
    quoted = '"a\nb",c'
    for head in (wide, quoted):
        assert files._head(io.BytesIO(f"{head}\r\n1,2\n".encode())) == head


def test_large_json_integers_are_compared_exactly(spark):
    rows = spark.sql("SELECT id, parse_json(concat('{\"n\": ', id, '}')) AS v FROM VALUES "
                     "('9007199254740992'), ('9007199254740993'), ('1.5'), ('\"x\"') AS t(id)")

    def kept(op, value):
        return sorted(r["id"] for r in filter_records(rows, {"field": "n", "op": op, "value": value}, root="v").collect())

    assert kept("==", 9007199254740992) == ["9007199254740992"]
    assert kept(">", 9007199254740992) == ["9007199254740993"]
    assert kept("in", [9007199254740993, 1.5]) == ["1.5", "9007199254740993"]
    assert kept("<", 2) == ["1.5"] and kept("<", 1 << 70) == ["1.5", "9007199254740992", "9007199254740993"]


def test_stores_are_opened_by_their_name_or_refused():
    assert locate("file:/a/b")[1] == "/a/b" and locate("/a:b/c")[1] == "/a:b/c"
    for uri in ("dbfs:/a", "wasbs://c@x/a", "dbfs:///a"):
        with pytest.raises(ValueError, match="cannot open"):
            locate(uri)


def test_file_names_with_glob_characters(spark, tmp_path):
    folder = tmp_path / "in[x]"
    folder.mkdir()
    text = "a record of sufficient length"
    (folder / "a[1].json").write_text(json.dumps([{"text": f"{text} 0"}]))
    (folder / "b{2}.json").write_text(json.dumps({"text": f"{text} 1"}) + "\n")
    (folder / "c[3].csv").write_text(f"text,n\n{text} 2,1\n")
    docs = files.read_documents(
        spark, str(folder), {"type": "field", "field": "text"}, min_chars=1, csv_schema=T._parse_datatype_string("text STRING, n INT"))
    assert sorted(r["text"] for r in docs.collect()) == [f"{text} {i}" for i in range(3)]


def test_arrow_files_of_differing_columns(spark, tmp_path):
    for name, table in (("a", pa.table({"x": pa.array([1, 2], pa.int32()), "s": ["p", "q"]})),
                        ("b", pa.table({"t": ["r"], "x": pa.array([1 << 40], pa.int64())}))):
        with pa.ipc.new_file(str(tmp_path / f"{name}.arrow"), table.schema) as writer:
            writer.write_table(table)
    rows = read_arrow(spark, str(tmp_path)).select("x", "s", "t").collect()
    assert sorted(map(tuple, rows)) == [(1, "p", None), (2, "q", None), (1 << 40, None, "r")]


def _tokenizer_file(folder, end):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 1, "b": 2}, "[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.add_special_tokens(end)
    folder.mkdir()
    tokenizer.save(str(folder / "tokenizer.json"))
    return str(folder / "tokenizer.json")


def test_special_ids_come_from_the_tokenizer_file(spark, tmp_path):
    one = FileTokenizer(spark, _tokenizer_file(tmp_path / "one", ["<pad>", "</s>"]))
    two = FileTokenizer(spark, _tokenizer_file(tmp_path / "two", ["<|endoftext|>"]))
    none = FileTokenizer(spark, _tokenizer_file(tmp_path / "none", []))
    made = [Config(output_dir="x", tokenizer=t) for t in (one, two)]
    assert [(c.eos_id, c.pad_id) for c in made] == [(4, 3), (3, 0)]
    with pytest.raises(ValueError, match="no end token"):
        Config(output_dir="x", tokenizer=none)
    assert Config(output_dir="x", tokenizer=none, eos_id=2).eos_id == 2
    docs = spark.createDataFrame([(0, "a b")], "ord INT, text STRING")
    assert [t.encode(docs).first()["ids"] for t in (one, two)] == [[1, 2], [1, 2]]


def test_datasets_by_their_own_settings(spark, tmp_path):
    for name, lines in (("p", ["first text", "first text", "x", "second one"]), ("q", ["third text here"] * 2)):
        (tmp_path / f"{name}.txt").write_text("\n".join(lines))
    out = tmp_path / "out"
    (out / "notes").mkdir(parents=True)
    (out / "notes" / "keep.txt").write_text("mine")
    inputs = {
        "p": Config(output_dir="", input=str(tmp_path / "p.txt"), txt_mode="lines", min_doc_chars=2, dedupe_prefix=5),
        "q/r": Config(output_dir="", input=str(tmp_path / "q.txt"), txt_mode="lines", min_doc_chars=1),
    }
    for _ in range(2):  # a second run replaces the first
        rows = run_datasets(spark, inputs, Config(output_dir=str(out), block_size=8, shard_size=16))
    docs = Counter({r["dataset"]: r["total_docs"] for r in rows.collect()})
    assert docs == {"p": 2, "q/r": 2} and (out / "notes" / "keep.txt").read_text() == "mine"
    folders = [str(out / "_manifests" / "dataset=p"), str(out / "_manifests" / "dataset=q%2Fr")]
    read = M.read_manifests(spark, folders)
    assert {r["source"]: r["total_docs"] for r in read.collect()} == docs
    listed = M.listed_shards(read)
    found = M.shard_files(spark, f"{out}/dataset=*/split=*/*/*.parquet")
    assert listed.count() == found.count() == M.existing_shards(listed, found).count()


def test_datasets_keep_or_refuse_every_setting(spark, tmp_path):
    docs = spark.createDataFrame(
        [("a", 0, "same text"), ("a", 1, "same text"), ("b", 0, "same text")], "dataset STRING, ord INT, text STRING")
    config = Config(output_dir=str(tmp_path / "out"), block_size=4, no_pack=True, dedupe_prefix=4)
    rows = write_datasets(docs, config).collect()
    assert sorted((r["dataset"], r["total_docs"], r["total_blocks"]) for r in rows) == [("a", 1, 1), ("b", 1, 1)]
    written = spark.read.parquet(config.output_dir).select("dataset", F.size("input_ids").alias("n")).collect()
    assert sorted(map(tuple, written)) == [("a", 3), ("b", 3)]
    with pytest.raises(ValueError, match="written as parquet or arrow, not bin"):
        write_datasets(docs, Config(output_dir="x", format="bin"))
