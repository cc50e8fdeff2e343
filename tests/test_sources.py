import json
import random
import re

import pytest
from pyspark.sql import functions as F

from blockloom.sources import files as S

TEXT = {"type": "field", "field": "text"}


def put(tmp_path, name, content):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def texts(spark, path, **options):
    docs = S.read_documents(spark, str(path), options.pop("spec", TEXT), min_chars=options.pop("min_chars", 1), **options)
    return [r["text"] for r in docs.orderBy("ord").collect()]


def raw(df):
    return [r["text"] for r in df.orderBy("_file", "_block", "_pos").collect()]


def plain_paragraphs(content: bytes):
    """One paragraph per run of non-empty lines."""
    text = re.sub("\r\n?", "\n", content.decode("utf-8", "replace"))
    out, run = [], []
    for line in text.split("\n"):
        if line:
            run.append(line)
        elif run:
            out.append("\n".join(run))
            run = []
    return out + (["\n".join(run)] if run else [])


def test_lines(spark, tmp_path):
    path = put(tmp_path, "a.txt", b"one\r\ntwo\n\n three \nbad\xff\nlast")
    assert raw(S.read_text(spark, path, mode="lines")) == ["one", "two", "", " three ", "bad�", "last"]


def test_whole_file(spark, tmp_path):
    path = put(tmp_path, "a.txt", "one\r\ntwo\rthree\n")
    assert raw(S.read_text(spark, path, mode="file")) == ["one\ntwo\nthree\n"]


@pytest.mark.parametrize("content", [
    "a\nb\n\nc\n\n\nd", "\n\n\na\n\n", "a\r\n\r\nb\r\nc\r\n\r\n\r\nd\r\n", "a\n \nb\n\t\n\nc", "a\n\r\nb\r\rc\n\n\r\nd", "", "\n", "x",
])
def test_paragraphs(spark, tmp_path, content):
    path = put(tmp_path, "a.txt", content)
    assert raw(S.read_text(spark, path)) == plain_paragraphs(content.encode())


@pytest.fixture
def split_bytes(spark):
    """Set the split size for a block of code; it must not apply to intermediate tables."""
    from contextlib import contextmanager

    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    @contextmanager
    def sized(size):
        try:
            for name, value in zip(names, (size, 1)):
                spark.conf.set(name, value)
            yield
        finally:
            for name, value in zip(names, before):
                spark.conf.set(name, value)

    return sized


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_paragraphs_at_split_borders(spark, tmp_path, split_bytes, newline):
    """Splits far smaller than a paragraph, and runs of newlines of every length around the borders."""
    rng = random.Random(5)
    content = "".join(rng.choice("abcé") * rng.randrange(1, 9) + newline * rng.choice([1, 1, 2, 2, 3, 4, 5, 7]) for _ in range(150))
    path = put(tmp_path, "a.txt", content)
    wanted = plain_paragraphs(content.encode())
    for size in (23, 64):
        with split_bytes(size):
            assert S.read_text(spark, path, mode="lines").rdd.getNumPartitions() > 10
            df = S.read_text(spark, path)
        assert raw(df) == wanted, size


def test_paragraphs_over_small_batches_and_files(spark, tmp_path):
    rng, wanted = random.Random(6), []
    for name in "abc":
        content = "".join(rng.choice("abc") * 3 + "\n" * rng.choice([1, 1, 1, 2, 3]) for _ in range(200))
        put(tmp_path, f"{name}.txt", content)
        wanted += plain_paragraphs(content.encode())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 7):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert raw(S.read_text(spark, f"{tmp_path}/*.txt")) == wanted, size
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_document_order_over_splits(spark, tmp_path, split_bytes):
    lines = [f"line {i} {'x' * (i % 50)}." for i in range(3000)]
    put(tmp_path, "b.txt", "\n".join(lines[:2000]))
    put(tmp_path, "c.txt", "\n".join(lines[2000:]))
    with split_bytes(4096):
        docs = S.read_documents(spark, str(tmp_path), TEXT, txt_mode="lines", min_chars=1)
    rows = docs.orderBy("ord").collect()
    assert [r["text"] for r in rows] == lines
    assert [r["ord"] for r in rows] == list(range(3000))


def test_jsonl(spark, tmp_path):
    lines = ['{"text": "a", "meta": {"text": "m"}}', "", "  ", "{broken", "7", '["x"]', ' {"text": ["b", "", "c"]} ', '{"text": 5}', '{"text": true}', '{"other": 1}', '{"text": null}']
    path = put(tmp_path, "a.jsonl", "\n".join(lines))
    assert texts(spark, path) == ["a", "b\nc", "5", "True"]
    assert texts(spark, path, spec={"type": "field", "field": "meta.text"}) == ["m"]


def test_json_arrays_and_lines(spark, tmp_path):
    put(tmp_path, "a.json", json.dumps([{"text": "a1"}, 5, "x", [1], None, {"text": "a2", "n": {"k": [1]}}]))
    put(tmp_path, "b.json", '{"text": "b1"}\n{"text": "b2"}\n[{"text": "not an object line"}]')
    put(tmp_path, "c.json", "[\n {\"text\": \"c1\"}\n,{\"text\": \"c2\"}]")
    assert texts(spark, tmp_path) == ["a1", "a2", "b1", "b2", "c1", "c2"]


def test_broken_json_array_fails(spark, tmp_path):
    put(tmp_path, "a.json", '[{"text": "a1"}, {"text": ')
    with pytest.raises(Exception):
        texts(spark, tmp_path)


def test_csv(spark, tmp_path):
    content = 'id,text,score\n1,"two\nlines, ""quoted""",0.5\n2,short\n3,long,0.1,extra\n\n4,,0.2\n5, padded ,\n'
    path = put(tmp_path, "a.csv", content)
    rows = S.read_csv(spark, path).orderBy("_pos").collect()
    assert [(r["id"], r["text"], r["score"]) for r in rows] == [
        (1, 'two\nlines, "quoted"', 0.5), (2, "short", None), (4, None, 0.2), (5, " padded ", None),
    ]
    assert texts(spark, path, spec={"field": "text", "filter": {"field": "score", "op": "<", "value": 1}}) == ['two\nlines, "quoted"']


def test_csv_files_with_different_headers(spark, tmp_path):
    put(tmp_path, "a.csv", "id,text\n1,one\n")
    put(tmp_path, "b.csv", "text,n,id\ntwo,5,x\n")
    put(tmp_path, "c.csv", "id,text\r\n3,three\r\n")
    assert texts(spark, tmp_path) == ["one", "two", "three"]


def test_delimiters(spark, tmp_path):
    assert texts(spark, put(tmp_path, "a.csv", "id;text\n1;a,b\n"), csv_delimiter=";") == ["a,b"]
    # Tab files ignore the delimiter setting.
    assert texts(spark, put(tmp_path, "a.tsv", "id\ttext\n1\ta;b\n"), csv_delimiter=";") == ["a;b"]


def test_discovery_order_and_types(spark, tmp_path):
    spark.createDataFrame([("p1",), ("p2",)], "text STRING").coalesce(1).write.parquet(str(tmp_path / "dir"))
    part = next((tmp_path / "dir").glob("part-*.parquet"))
    flat = tmp_path / "flat"
    flat.mkdir()
    (flat / "z.parquet").write_bytes(part.read_bytes())
    put(flat, "b.jsonl", '{"text": "l"}')
    put(flat, "a.json", '[{"text": "j"}]')
    put(flat, "a.csv", "text\nc\n")
    put(flat, "a.tsv", "text\nt\n")
    put(flat, "b.txt", "x2")
    put(flat, "a.txt", "x1")
    put(flat, "a.text", "x3")
    put(flat, "ignored.md", "no")
    (flat / "sub").mkdir()
    put(flat / "sub", "deep.txt", "no")
    assert texts(spark, flat) == ["p1", "p2", "l", "j", "c", "t", "x1", "x2", "x3"]
    assert texts(spark, flat, file_type="txt") == ["x1", "x2", "x3"]
    assert texts(spark, flat / "ignored.md") == ["no"]
    assert texts(spark, flat / "b.jsonl", file_type="txt") == ['{"text": "l"}']
    with pytest.raises(FileNotFoundError):
        S.discover(spark, str(tmp_path / "dir" / "none"))
    with pytest.raises(FileNotFoundError):
        S.discover(spark, str(flat), "arrow")


def test_parquet_nested_and_nan(spark, tmp_path):
    rows = [("a", ["x", None, "y"], 0.1, ("n",)), ("b", [], float("nan"), (None,))]
    spark.createDataFrame(rows, "text STRING, l ARRAY<STRING>, d DOUBLE, s STRUCT<k: STRING>").coalesce(1).write.parquet(str(tmp_path / "p"))
    assert texts(spark, tmp_path / "p", file_type="parquet", spec={"field": "l"}) == ["x\ny"]
    assert texts(spark, tmp_path / "p", file_type="parquet", spec={"field": "s.k"}) == ["n"]
    assert texts(spark, tmp_path / "p", file_type="parquet", spec={"field": "text", "filter": {"field": "d", "op": ">", "value": 0}}) == ["a"]


def test_chunks_of_lines(spark, tmp_path):
    put(tmp_path, "a.txt", "\n".join(str(i) for i in range(7)) + "\n")
    put(tmp_path, "b.txt", "\n\nx")
    chunks = S.order_chunks(S.chunk_lines(spark, f"{tmp_path}/*.txt", chunk_size=3))
    assert [r["text"] for r in chunks.orderBy("ord").collect()] == ["0\n1\n2", "3\n4\n5", "6", "\n\nx"]
    assert [r["ord"] for r in chunks.orderBy("ord").collect()] == [0, 1, 2, 3]


def test_named_dataset_reads_only_its_partitions(spark, tmp_path):
    df = spark.createDataFrame([("d", "c1", "train", "a"), ("d", "c2", "train", "b"), ("d", "c1", "test", "c"), ("e", "c1", "train", "d")], "dataset STRING, config STRING, split STRING, text STRING")
    df.write.partitionBy("dataset", "config", "split").parquet(str(tmp_path / "hub"))
    got = S.read_named_dataset(spark, str(tmp_path / "hub"), "d")
    assert {r["text"] for r in got.collect()} == {"a", "b"}
    assert [r["text"] for r in S.read_named_dataset(spark, str(tmp_path / "hub"), "d", "c1", "test").collect()] == ["c"]
    assert "PartitionFilters: [isnotnull" in got._jdf.queryExecution().executedPlan().toString()


def test_extraction_reads_only_named_columns(spark, sf):
    from blockloom.plans.spec import extract

    df = extract(S.read_parquet(spark, f"{sf}/documents.parquet"), TEXT, carry=("doc_id",))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string" in plan and "source" not in plan


def test_arrow_files_split_by_batches(spark, tmp_path):
    import pyarrow as pa

    from blockloom.sources.arrow_ipc import read_arrow

    schema = pa.schema([("text", pa.string()), ("tags", pa.list_(pa.string())), ("s", pa.struct([("k", pa.float64())]))])
    for name in ("a.arrow", "b.ipc"):
        with pa.ipc.new_file(str(tmp_path / name), schema) as writer:
            for at in range(0, 50, 10):
                writer.write_batch(pa.record_batch([
                    pa.array([f"{name}{i}" for i in range(at, at + 10)]), pa.array([["x", "y"]] * 10), pa.array([{"k": float("nan")}] * 10)], schema=schema))
    one = read_arrow(spark, str(tmp_path / "a.arrow"), split_bytes=1000)
    assert one.rdd.getNumPartitions() > 1
    assert raw(one) == [f"a.arrow{i}" for i in range(50)]
    assert texts(spark, tmp_path, file_type="arrow") == [f"{n}{i}" for n in ("a.arrow", "b.ipc") for i in range(50)]
    assert texts(spark, tmp_path, file_type="arrow", spec={"field": "tags"}) == ["x\ny"] * 100
    # Without a forced type a folder is searched for the first extension only.
    assert texts(spark, tmp_path) == [f"a.arrow{i}" for i in range(50)]


def test_jsonl_records_beyond_the_variant_limit_fail(spark, tmp_path):
    large = "a" * (129 << 20)
    path = put(tmp_path, "broken.jsonl", '{"t": "' + large + '\n{"t": "kept"}')
    assert S.read_jsonl(spark, path).count() == 1
    path = put(tmp_path, "large.jsonl", '{"t": "' + large + '"}\n{"t": "kept"}')
    with pytest.raises(Exception, match="does not fit a variant"):
        S.read_jsonl(spark, path).count()


def test_mixed_folder_holds_many_rows_per_file(spark, sf, monkeypatch):
    from blockloom.catalog import files
    folders, read = [], files.S.read_documents
    monkeypatch.setattr(files.S, "read_documents", lambda s, folder, *a, **k: folders.append(folder) or read(s, folder, *a, **k))
    found = sorted(r["ord"] for r in files.scan_mixed_dir(spark, sf).collect())
    assert found == list(range(len(found)))
    n_files = len(spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folders[0]).select("path").collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert n_files == docs.where("lang = 'es'").selectExpr("doc_id div 100").distinct().count()


def test_no_task_holds_the_whole_landed_dataset(spark, sf):
    from blockloom.catalog.files import run_named_dataset
    frame = run_named_dataset(spark, sf)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(ord" not in plan  # a window over all rows is one task
    assert sorted(r["place"] for r in frame.collect()) == list(range(frame.count()))
