import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockloom.operators import manifests as M
from blockloom.operators.packing import cut_stream
from blockloom.operators.sampling import (
    draw_from_files, draw_from_shards, index_rows, sample_blocks, sample_windows, synthetic_tokens)
from blockloom.operators.stats import dry_run_stats, mixture_share, preview
from blockloom.plans.pipeline import Config, dry_run, run_pipeline, run_text, show_samples, write_corpus, write_datasets
from blockloom.sources import blocks as B
from blockloom.sources.flat_tokens import read_flat_tokens, read_runs


def text_of(i, size):
    return (hashlib.md5(str(i).encode()).hexdigest() * 2)[: size + i % 7]


def corpus(spark, n=60, size=40):
    return spark.createDataFrame([(i, text_of(i, size)) for i in range(n)], "ord BIGINT, text STRING")


def plain_stream(n=60, size=40):
    return [t for i in range(n) for t in [*(b + 3 for b in text_of(i, size).encode()), 1]]


@pytest.mark.parametrize("layout, compression", [("parquet", "zstd"), ("parquet", "none"), ("arrow", "lz4"), ("arrow", "zstd"), ("arrow", "none")])
def test_shards_round_trip(spark, tmp_path, layout, compression):
    config = Config(output_dir=str(tmp_path / "out"), block_size=16, shard_size=160, val_split=0.2, format=layout, compression=compression)
    row = write_corpus(corpus(spark), config).first()
    stream = plain_stream()
    n_blocks = -(-len(stream) // 17) - (len(stream) % 17 == 1)
    assert (row["total_blocks"], row["total_tokens"], row["total_docs"]) == (n_blocks, n_blocks * 16, 60)
    n_shards = -(-n_blocks // 10)
    assert (len(row["train_shards"]), len(row["val_shards"])) == (n_shards - int(n_shards * 0.2), int(n_shards * 0.2))
    assert row["format"] == layout and row["compression"] == compression and row["field_map"] is None
    manifest = f"{tmp_path}/out/manifest.json"
    read = [B.read_blocks(spark, s, "arrow", manifest=manifest, block_size=16).collect() for s in ("train", "val")]
    direct = [
        B.read_blocks(spark, s, "arrow", train_dir=config.output_dir, val_dir=config.output_dir, layout=layout).collect()
        for s in ("train", "val")
    ]
    blocks = [stream[i:i + 17] for i in range(0, len(stream), 17)][:n_blocks]
    blocks[-1] = blocks[-1] + [0] * (17 - len(blocks[-1]))
    wanted = sorted((b[:-1], b[1:], sum(t != 0 for t in b[:-1])) for b in blocks)
    for rows in (read, direct):
        assert sorted((list(r["input_ids"]), list(r["labels"]), r["length"]) for part in rows for r in part) == wanted
    # Rows of a shard keep the order of the stream.
    first = {}
    for r in sorted(read[0], key=lambda r: (r["shard_idx"], r["row"])):
        place = blocks.index([*r["input_ids"], r["labels"][-1]])
        assert place > first.get(r["shard_idx"], -1)
        first[r["shard_idx"]] = place


def test_arrow_shard_file_is_plain_arrow(spark, tmp_path):
    config = Config(output_dir=str(tmp_path / "out"), block_size=16, shard_size=10**6, format="arrow")
    write_corpus(corpus(spark), config)
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.endswith(".arrow") or "_staging" in p.name)
    # A single shard goes to validation.
    assert names == ["val_shard_00000.arrow"]
    table = pa.ipc.open_file(str(tmp_path / "out" / names[0])).read_all()
    assert table.schema.names == ["input_ids", "labels", "length"]
    assert table.schema.field("input_ids").type == pa.list_(pa.int32()) and table.schema.field("length").type == pa.int32()


def test_flat_output(spark, tmp_path):
    config = Config(output_dir=str(tmp_path / "out"), block_size=16, val_split=0.3, format="bin", compression="zstd")
    row = write_corpus(corpus(spark), config).first()
    assert row["compression"] == "none" and row["total_tokens"] == row["total_blocks"] * 16
    stream, kept = plain_stream(), []
    for split in ("train", "val"):
        parts = sorted((tmp_path / "out" / f"{split}.bin").glob("part-*.bin"))
        kept.append(np.concatenate([np.fromfile(p, dtype="<u4") for p in parts]).reshape(-1, 16))
    blocks = {tuple(stream[i:i + 16]) for i in range(0, len(stream) - 16, 17)}
    assert blocks <= {tuple(b) for part in kept for b in part.tolist()}


@pytest.mark.parametrize("n", [16, 17, 18, 100])
def test_flat_files_in_runs_over_file_borders(spark, tmp_path, n):
    ids = np.arange(n, dtype="<u4")
    ids[:11].tofile(tmp_path / "part-0.bin")
    ids[11:].tofile(tmp_path / "part-1.bin")
    stream = read_flat_tokens(spark, str(tmp_path), run=4, split_bytes=20)
    runs = [list(r["tokens"]) for r in cut_stream(stream, 16).orderBy("block_id").collect()]
    assert [t for run in runs for t in run] == list(range(n)) and all(len(r) == 16 for r in runs[:-1])
    drawn_from = cut_stream(stream, 16)
    if n <= 16:
        with pytest.raises(ValueError):
            sample_windows(drawn_from, n, 16, 1, 1)
        return
    rows = sample_windows(drawn_from, n, 16, 10, 8).collect()
    assert len(rows) == 80
    for r in rows:
        assert list(r["input_ids"]) == list(range(r["start"], r["start"] + 16))
        assert list(r["labels"]) == list(range(r["start"] + 1, r["start"] + 17))
    assert {r["start"] for r in rows} <= set(range(n - 16))
    if n == 18:
        assert {r["start"] for r in rows} == {0, 1}


@pytest.mark.parametrize("sizes", [[5, 0, 1, 30, 3], [16, 16], [7], [1] * 9, [20, 4, 33, 64]])
def test_runs_are_merged_at_file_borders_only(spark, tmp_path, sizes):
    ids, at = np.arange(sum(sizes), dtype="<u4"), 0
    for i, n in enumerate(sizes):
        ids[at:at + n].tofile(tmp_path / f"part-{i:03}.bin")
        at += n
    runs = [r["tokens"] for r in read_runs(spark, str(tmp_path), run=8, split_bytes=64).orderBy("block_id").collect()]
    assert runs == [ids[i:i + 8].tolist() for i in range(0, at, 8)]
    plan = read_runs(spark, str(tmp_path), run=8)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Union") < plan.index("Exchange") and plan.count("Exchange") == 1
    if at > 8:
        drawn = draw_from_files(spark, [str(tmp_path)], 8, 9, 7).collect()
        names = ("step", "slot", "start", "input_ids", "labels")
        want = sample_windows(read_runs(spark, str(tmp_path), run=8), at, 8, 9, 7).collect()
        assert sorted(tuple(r[c] for c in names) for r in drawn) == sorted(tuple(r[c] for c in names) for r in want)
        plan = draw_from_files(spark, [str(tmp_path)], 8, 9, 7)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.index("MapInArrow") < plan.index("Exchange") < plan.index("Range (")


@pytest.mark.parametrize("layout", ["parquet", "arrow"])
def test_draws_go_to_the_shards(spark, tmp_path, layout):
    config = Config(output_dir=str(tmp_path / "out"), block_size=16, shard_size=64, val_split=0.3, format=layout)
    write_corpus(corpus(spark), config)
    rows = B.read_dir_blocks(spark, config.output_dir, "train", layout)
    shards = B.block_shards(spark, "train", directory=config.output_dir, layout=layout)
    want = {(r["shard_idx"], r["n"]) for r in rows.groupBy("shard_idx").agg(F.count("*").alias("n")).collect()}
    assert {(r["shard_idx"], r["n_rows"]) for r in shards.collect()} == want and len(want) > 1
    listed = B.block_shards(spark, "train", manifest=f"{config.output_dir}/manifest.json")
    assert sorted(map(str, listed.drop("path").collect())) == sorted(map(str, shards.drop("path").collect()))
    total = rows.count()
    names = ("step", "slot", "row_index", "input_ids", "labels")
    old = sample_blocks(index_rows(rows, B.SHARD_KEYS, "row"), total, 40, 5).collect()
    new = draw_from_shards(shards, 16, 40, 5)
    assert sorted(tuple(r[c] for c in names) for r in new.collect()) == sorted(tuple(r[c] for c in names) for r in old)
    plan = draw_from_shards(shards, 16, 40, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    with pytest.raises(ValueError):
        B.block_shards(spark)


def test_ragged_flat_file_fails(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    with pytest.raises(Exception, match="whole number"):
        read_flat_tokens(spark, str(tmp_path)).collect()


def test_block_draws_do_not_depend_on_partitioning(spark):
    rows = spark.range(97).select(
        F.expr("id div 10").alias("shard"), (F.col("id") % 10).alias("row"), F.array("id").alias("input_ids"), F.array("id").alias("labels"))
    indexed = index_rows(rows.repartition(5), ["shard"], "row")
    assert {(r["row_index"], r["input_ids"][0]) for r in indexed.collect()} == {(i, i) for i in range(97)}
    one = sorted(sample_blocks(indexed, 97, 50, 8).collect())
    assert one == sorted(sample_blocks(indexed.repartition(3), 97, 50, 8).collect())
    assert len(one) == 400 and {(r["step"], r["slot"]) for r in one} == {(s, k) for s in range(50) for k in range(8)}
    assert len({r["row_index"] for r in one}) > 80
    with pytest.raises(ValueError):
        sample_blocks(indexed, 0, 1, 1)


def test_synthetic_stream(spark):
    rows = synthetic_tokens(spark, 2000, 100).collect()
    assert {r["token"] for r in rows} == set(range(100))
    assert sum(r["split"] == "val" for r in rows) == 100 and all(r["pos"] >= 1900 for r in rows if r["split"] == "val")


def test_combining_manifests(spark, tmp_path):
    docs = corpus(spark).withColumn("dataset", F.when(F.col("ord") < 20, "owner/small").otherwise("big one"))
    config = Config(output_dir=str(tmp_path / "out"), block_size=16, shard_size=160)
    rows = write_datasets(docs, config)
    dirs = []
    for r in rows.collect():
        directory = str(tmp_path / r["dataset"].replace("/", "_"))
        lost = [f"{tmp_path}/out/gone/shard_idx=7"] if r["dataset"] == "big one" else []
        one = rows.where(F.col("dataset") == r["dataset"]).drop("dataset").withColumn(
            "train_shards", F.concat("train_shards", F.array(*[F.lit(p) for p in lost]).cast("array<string>")))
        M.write_manifest(one, directory)
        dirs.append(directory)
    manifests = M.read_manifests(spark, [*sorted(dirs), str(tmp_path / "absent")])
    files = M.shard_files(spark, f"{tmp_path}/out/dataset=*/split=*/*/*.parquet")
    listed = M.listed_shards(manifests)
    total = sum(len(r["train_shards"]) + len(r["val_shards"]) for r in rows.collect())
    assert M.existing_shards(listed, files).count() == total
    assert [tuple(r) for r in M.missing_shards(listed, files, ("input_dir",)).collect()] == [(sorted(dirs)[0], 1)]
    M.write_manifest(M.combined_manifest(manifests, files, sorted(dirs)), str(tmp_path / "all"))
    text = "".join(p.read_text() for p in (tmp_path / "all" / "manifest.json").glob("part-*"))
    combined = json.loads(text)
    assert list(combined) == [
        "format", "tokenizer", "block_size", "total_blocks", "total_tokens", "total_docs", "train_shards", "val_shards", "source", "input_dirs"]
    assert combined["total_docs"] == 60 and combined["input_dirs"] == sorted(dirs) and combined["source"] == "combined"
    assert len(combined["train_shards"]) + len(combined["val_shards"]) == total
    # Input order first: all shards of the first manifest stand before those of the second.
    assert [("big" in s) for s in combined["train_shards"]] == sorted([("big" in s) for s in combined["train_shards"]], reverse=True)
    with pytest.warns(UserWarning, match="block size"):
        back = B.read_manifest_blocks(spark, f"{tmp_path}/all/manifest.json", "train", 99)
    assert back.count() + B.read_manifest_blocks(spark, f"{tmp_path}/all/manifest.json", "val").count() == combined["total_blocks"]
    with pytest.raises(FileNotFoundError):
        M.read_manifests(spark, [str(tmp_path / "absent")])


def test_run_from_files(spark, tmp_path):
    lines = [json.dumps({"meta": {"body": f"{i % 40:03d} " + "text " * 20}, "score": i}) for i in range(80)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    spec = {"type": "field", "field": "meta.body", "filter": {"field": "score", "op": "<", "value": 60}}
    config = Config(output_dir=str(tmp_path / "out"), input=str(tmp_path / "in"), field_map=spec, block_size=64, dedupe_prefix=10)
    row = run_pipeline(spark, config).first()
    stream = 40 * (103 + 1)  # 60 pass the score, 40 prefixes are distinct
    assert row["total_docs"] == 40 and row["total_blocks"] == stream // 65 + (stream % 65 >= 2)
    dry = dry_run(spark, config).first()
    assert dry["n_docs"] == 40 and dry["est_tokens"] == int(40 * 103 * 0.25) and dry["est_shards"] == 1
    assert [r["sample"][:3] for r in show_samples(spark, config, 3).collect()] == ["000", "001", "002"]


def test_text_files_to_flat_stream(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\nthree\n")
    (tmp_path / "b.txt").write_text("four")
    for add_eos in (True, False):
        stream = [t for doc in ("one\ntwo", "three", "four") for t in [*(b + 3 for b in doc.encode()), *([1] if add_eos else [])]]
        out = tmp_path / f"out{add_eos}"
        row = run_text(spark, [f"{tmp_path}/*.txt"], f"{out}/t.bin", add_eos=add_eos, chunk_size=2, block_size=4).first()
        assert (row["total_tokens"], row["n_sequences"]) == (len(stream), len(stream) // 4)

        def held(name):
            return [t for p in sorted((out / name).glob("part-*.bin")) for t in np.fromfile(p, dtype="<u4").tolist()]

        assert held("t.bin") == stream
        # A second run replaces the files of the first.
        run_text(spark, [f"{tmp_path}/*.txt"], f"{out}/t.bin", val_split=0.5, add_eos=add_eos, chunk_size=2)
        cut = int(len(stream) * 0.5)
        assert held("t.bin") == stream[:cut] and held("t_val.bin") == stream[cut:]


def test_datasets_without_a_name_are_kept(spark, tmp_path):
    docs = corpus(spark, 30).withColumn("dataset", F.when(F.col("ord") < 10, "named").when(F.col("ord") < 20, ""))
    rows = write_datasets(docs, Config(output_dir=str(tmp_path / "out"), block_size=16)).collect()
    assert {(r["dataset"], r["total_docs"]) for r in rows} == {("named", 10), ("unnamed", 20)}


def test_preview_and_empty_dry_run(spark):
    df = spark.createDataFrame([(1, "x" * 501), (0, "y" * 500)], "ord INT, text STRING")
    assert [r["sample"] for r in preview(df, 2).collect()] == ["y" * 500, "x" * 500 + "..."]
    empty = dry_run_stats(df.where("false")).first()
    assert (empty["n_docs"], empty["avg_chars"], empty["est_tokens"], empty["est_shards"]) == (0, 0.0, 0, 1)


def test_mixture_report(spark):
    df = spark.createDataFrame([("a", "train", 3), ("b", "train", 1), ("a", "val", 1)], "dataset STRING, split STRING, n_blocks INT")
    got = {(r["split"], r["dataset"]): (r["n_blocks"], r["share"]) for r in mixture_share(df).collect()}
    assert got == {
        ("train", "a"): (3, 0.75), ("train", "b"): (1, 0.25), ("val", "a"): (1, 1.0),
        ("train", "all"): (4, 1.0), ("val", "all"): (1, 1.0), ("all", "all"): (5, 1.0),
    }


def test_reader_choice_errors(spark):
    for options in ({"data_format": "bin"}, {"data_format": "arrow"}, {"data_format": "arrow", "train_dir": "x"}, {"split": "test"}):
        with pytest.raises(ValueError):
            B.read_blocks(spark, **options)
