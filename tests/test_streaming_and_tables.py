import datetime
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from blockloom.operators import nexttoken as N
from blockloom.operators.dedupe import dedupe_prefix
from blockloom.operators.packing import pack_blocks, shift_labels
from blockloom.operators.tokenize import ByteTokenizer, VocabTokenizer, build_vocabulary, load_tokenizer
from blockloom.session import shared_dir
from blockloom.streaming import ingest as I
from blockloom.streaming.pack import flushed_blocks, stream_pack


def test_dedupe_keeps_the_first_and_splits_hot_prefixes(spark):
    rows = [(i, "same prefix " + str(i)) for i in range(500)] + [(1000 + i, f"{i:04d} other") for i in range(100)] + [(-1, "sam"), (2000, "sam")]
    docs = spark.createDataFrame(rows, "ord BIGINT, text STRING").repartition(7)
    kept = {r["ord"] for r in dedupe_prefix(docs, 4).collect()}
    assert kept == {0, -1, *range(1000, 1100)}
    assert dedupe_prefix(docs, 0).count() == len(rows)


def test_dedupe_counts_code_points(spark):
    docs = spark.createDataFrame([(0, "😀😀a"), (1, "😀😀b"), (2, "😀c")], "ord BIGINT, text STRING")
    assert {r["ord"] for r in dedupe_prefix(docs, 2).collect()} == {0, 2}


def test_byte_ids(spark):
    docs = spark.createDataFrame([(0, "aé😀"), (1, "")], "ord BIGINT, text STRING")
    rows = ByteTokenizer().encode(docs).orderBy("ord").collect()
    assert [list(r["ids"]) for r in rows] == [[b + 3 for b in "aé😀".encode()], []]
    assert [r["n_ids"] for r in rows] == [7, 0]


def test_vocabulary_order_and_unknown_pieces(spark):
    docs = spark.createDataFrame([(0, "b b a, a c"), (1, ""), (2, " \n "), (3, "zé12zé")], "ord BIGINT, text STRING")
    vocabulary = build_vocabulary(docs, 4)
    # a, b and zé occur twice each; of the rest "," sorts first.
    assert {r["piece"]: r["id"] for r in vocabulary.collect()} == {"a": 3, "b": 4, "zé": 5, ",": 6}
    rows = VocabTokenizer(vocabulary, 4).encode(docs).orderBy("ord").collect()
    assert [list(r["ids"]) for r in rows] == [[4, 4, 3, 6, 3, 2], [], [], [5, 2, 5]]


def test_tokenizer_by_name(spark):
    assert load_tokenizer(spark, "bytes").vocab_size == 259
    with pytest.raises(ValueError):
        load_tokenizer(spark, "/no/such/tokenizer.json")
    with pytest.warns(UserWarning):
        assert load_tokenizer(spark, "/no/such/tokenizer.json", fallback="bytes").name == "bytes"


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def write_batches(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return I.read_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)


def test_stream_packer_carries_the_tail(spark, tmp_path):
    batches = [[("a", "x" * 7), ("b", "y" * 20)], [("a", "z" * 3)], [("a", "w" * 30), ("b", "v")]]
    docs = write_batches(spark, str(tmp_path / "in"), batches, "lane STRING, text STRING")
    I.write_available(stream_pack(docs, 8), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    blocks = flushed_blocks(spark.read.parquet(str(tmp_path / "out")), 8)
    for lane in "ab":
        rows = [(i, t) for i, (_, t) in enumerate(r for batch in batches for r in batch if r[0] == lane)]
        wanted = pack_blocks(spark.createDataFrame(rows, "ord BIGINT, text STRING"), 8, ByteTokenizer())
        got = blocks.where(F.col("lane") == lane)
        assert [list(r["tokens"]) for r in got.orderBy("block_id").collect()] == [list(r["tokens"]) for r in wanted.orderBy("block_id").collect()]


def test_stream_dedupe_and_resume(spark, tmp_path):
    batches = [[(1, "aaaa1"), (2, "bbbb1")], [(3, "aaaa2"), (4, "cccc1")]]
    docs = write_batches(spark, str(tmp_path / "in"), batches, "doc_id BIGINT, text STRING")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):
        I.write_resumable(I.stream_dedupe(docs, 4), out, mark).awaitTermination()
    assert Counter(r["prefix_md5"] for r in spark.read.parquet(out).collect()).most_common(1)[0][1] == 1
    assert spark.read.parquet(out).count() == 3
    # Files that arrive later are picked up where the first run ended.
    spark.createDataFrame([(5, "bbbb2"), (6, "dddd1")], "doc_id BIGINT, text STRING").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    I.write_resumable(I.stream_dedupe(docs, 4), out, mark).awaitTermination()
    assert {r["doc_id"] for r in spark.read.parquet(out).where("doc_id > 4").collect()} == {6}
    assert spark.read.parquet(out).count() == 4


def test_stream_dedupe_with_bounded_state(spark, tmp_path):
    schema = "doc_id BIGINT, at TIMESTAMP, text STRING"
    day = [datetime.datetime(2024, 1, d) for d in range(1, 10)]
    batches = [[(1, day[0], "aaaa1"), (2, day[0], "aaaa2")], [(3, day[5], "bbbb1")], [(4, day[6], "cccc1")], [(5, day[7], "aaaa3"), (6, day[7], "cccc2")]]
    docs = write_batches(spark, str(tmp_path / "in"), batches, schema)
    unique = I.stream_dedupe(docs, 4, event_time="at", delay="2 days")
    I.write_available(unique, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    # The first prefix was forgotten in the meantime, the third was not.
    kept = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(kept & {1, 2}) == 1 and kept - {1, 2} == {3, 4, 5}


def test_pairs_skip_padding_and_block_borders(spark):
    docs = spark.createDataFrame([(0, "abab"), (1, "b")], "ord BIGINT, text STRING")
    counts = {(r["prev"], r["next"]): r["n"] for r in N.bigram_counts(shift_labels(pack_blocks(docs, 4))).collect()}
    a, b = ord("a") + 3, ord("b") + 3
    # The stream a b a b | eos b eos: the first block holds five tokens, the second b and eos.
    assert counts == {(a, b): 2, (b, a): 1, (b, 1): 2}


SCORED = [(7, 1, 2.0), (7, 2, 1.0), (7, 3, 1.0), (7, 4, -1.0), (8, 1, 0.0)]


def scored(spark):
    return spark.createDataFrame(SCORED, "context INT, token INT, score DOUBLE")


def test_topk_keeps_ties(spark):
    kept = {(r["context"], r["token"]) for r in N.topk_next(scored(spark), 2).collect()}
    assert kept == {(7, 1), (7, 2), (7, 3), (8, 1)}


def test_softmax_and_nucleus(spark):
    for temperature in (1.0, 0.5):
        weights = [math.exp(s / temperature) for c, _, s in SCORED if c == 7]
        shares = {r["token"]: r["share"] for r in N.softmax_share(scored(spark), temperature).where("context = 7").collect()}
        assert shares == pytest.approx({t + 1: w / sum(weights) for t, w in enumerate(weights)})
    kept = {(r["context"], r["token"]) for r in N.nucleus_next(scored(spark), 0.6).collect()}
    assert kept == {(7, 1), (7, 2), (8, 1)}  # 0.57 lies before token 2, 0.78 before token 3


def test_repetition_penalty_once_per_occurrence(spark):
    seen = spark.createDataFrame([(7, 1, 2), (7, 4, 3), (9, 1, 5)], "context INT, token INT, n_seen BIGINT")
    got = {(r["context"], r["token"]): r["penalized"] for r in N.repetition_penalty(scored(spark), seen, 2.0).collect()}
    assert got == {(7, 1): 0.5, (7, 2): 1.0, (7, 3): 1.0, (7, 4): -8.0, (8, 1): 0.0}


def test_heldout_loss(spark):
    train = spark.createDataFrame([(1, 2, 3), (1, 3, 1)], "prev INT, next INT, n BIGINT")
    val = spark.createDataFrame([(1, 2, 2), (1, 9, 1), (5, 5, 1)], "prev INT, next INT, n BIGINT")
    row = N.heldout_perplexity(train, val, 10).first()
    loss = -(2 * math.log(4 / 14) + math.log(1 / 14) + math.log(1 / 10)) / 4
    assert row["n_pairs"] == 4 and row["loss"] == pytest.approx(loss) and row["perplexity"] == pytest.approx(math.exp(loss))
    assert N.heldout_perplexity(train, val, 10**12).first()["perplexity"] == math.inf


@pytest.mark.parametrize("files", [1, 3])
def test_streamed_table_is_a_file_or_a_folder_of_files(spark, tmp_path, files):
    from blockloom.catalog.streams import stream_extract
    rows = [(i, f"{i} " + "text " * 20, "en", "web", 102) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    target = tmp_path / "documents.parquet"
    if files == 1:
        docs.toPandas().to_parquet(target)
    else:
        docs.repartition(files).write.parquet(str(target))
    assert sorted(r["doc_id"] for r in stream_extract(spark, str(tmp_path)).collect()) == list(range(30))


def test_a_micro_batch_is_as_many_files_as_its_bytes_need(spark, sf, tmp_path):
    from blockloom.catalog import streams
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        wanted = spark.read.parquet(f"{sf}/documents.parquet").rdd.getNumPartitions()
        ids = []
        I.write_resumable(streams._arriving(spark, sf), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
        assert wanted > 3 and spark.read.parquet(str(tmp_path / "out")).select("batch_id").distinct().count() <= 3

        def note(stream):
            def each(batch, number):
                files = batch.selectExpr("input_file_name() AS f").distinct().count()
                ids.append((number, files, *batch.selectExpr("min(doc_id)", "max(doc_id)").first()))
            return stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "notes")).trigger(availableNow=True).start()
        streams._in_order(spark, sf, note)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [n for n, *_ in ids] == [0, 1, 2] and all(a[3] < b[2] for a, b in zip(ids, ids[1:]))
