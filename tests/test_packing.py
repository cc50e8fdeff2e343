import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.operators import packing as P
from blockloom.operators.order import with_start
from blockloom.operators.splits import split_blocks, split_position, split_shards
from blockloom.operators.stats import run_stats
from blockloom.operators.tokenize import ByteTokenizer

IDS = "ord BIGINT, ids ARRAY<INT>, n_ids BIGINT"


def docs_of(spark, lists, partitions=1):
    rows = [(i, ids, len(ids)) for i, ids in enumerate(lists)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, IDS).repartition(partitions)


def plain_blocks(lists, block_size, eos=1, pad=0):
    stream = [t for ids in lists for t in [*ids, eos]]
    width = block_size + 1
    blocks = [stream[i:i + width] for i in range(0, len(stream), width)]
    if blocks and len(blocks[-1]) < 2:
        blocks.pop()
    return [b + [pad] * (width - len(b)) for b in blocks]


def collected(blocks):
    return [list(r["tokens"]) for r in blocks.orderBy("block_id").collect()]


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_blocks_equal_a_plain_loop(spark, partitions):
    rng = random.Random(partitions)
    lists = [[rng.randrange(2, 99) for _ in range(rng.choice([0, 1, 7, 8, 9, 24, 100]))] for _ in range(300)]
    assert collected(P.pack_blocks(docs_of(spark, lists, partitions), 8)) == plain_blocks(lists, 8)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(2, 50), max_size=12), min_size=1, max_size=8), st.integers(1, 6))
def test_any_documents_and_block_size(spark, lists, block_size):
    assert collected(P.pack_blocks(docs_of(spark, lists), block_size)) == plain_blocks(lists, block_size)


@pytest.mark.parametrize("lengths", [[4], [5], [6], [8], [9], [9, 0], [0], [9, 9], [0, 0]])
def test_tails(spark, lengths):
    """Width 5: tails of 0 and 1 tokens go, tails of 2 and more are padded."""
    lists = [[7] * n for n in lengths]
    assert collected(P.pack_blocks(docs_of(spark, lists), 4)) == plain_blocks(lists, 4)
    total = sum(lengths) + len(lengths)
    full = collected(P.pack_blocks(docs_of(spark, lists), 4, flush=False))
    assert len(full) == total // 5
    stats = run_stats(docs_of(spark, lists), 4).first()
    assert stats["total_blocks"] == len(plain_blocks(lists, 4)) and stats["tokens_seen"] == total


def test_bytes_and_ids_pack_alike(spark):
    texts = ["", "é😀", "plain", "x" * 1000]
    df = spark.createDataFrame(list(enumerate(texts)), "ord BIGINT, text STRING")
    lists = [[b + 3 for b in t.encode()] for t in texts]
    assert collected(P.pack_blocks(df, 16, ByteTokenizer())) == plain_blocks(lists, 16)
    assert collected(P.pack_blocks(ByteTokenizer().encode(df), 16)) == plain_blocks(lists, 16)


def test_orders_with_gaps_negative_and_large(spark):
    orders = [-5000, -1, 0, 255, 256, 10**6, 2**40, 2**40 + 1]
    df = spark.createDataFrame([(o, 3) for o in orders], "ord BIGINT, n BIGINT")
    got = {r["ord"]: r["start"] for r in with_start(df, "n").collect()}
    assert got == {o: 3 * i for i, o in enumerate(orders)}


def _sparse_orders(n, seed):
    """Hashed 64-bit numbers of both signs, with the smallest, the largest and a dense run among them."""
    rng = random.Random(seed)
    return sorted({-2**63, 2**63 - 1, -1, 0, *range(10**12, 10**12 + n // 10), *(rng.getrandbits(64) - 2**63 for _ in range(n))})


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_totals_over_any_orders(spark, keys):
    orders = _sparse_orders(20000, 5)
    rows = [(o, i % 5, "ab"[i % 2]) for i, o in enumerate(orders)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "ord BIGINT, n BIGINT, k STRING").repartition(5)
    want, total = {}, {}
    for o, n, k in rows:
        k = k if keys else ""
        want[o] = total.get(k, 0)
        total[k] = want[o] + n
    assert {r["ord"]: r["start"] for r in with_start(df, "n", keys).collect()} == want


def test_no_window_sees_more_than_a_range():
    """Of any 64-bit orders, a range of each level holds at most 2^19 ranges of the one below, and so has the last window."""
    from blockloom.operators import order
    assert order.BUCKET_BITS + (order.LEVELS + 1) * order.LEVEL_BITS >= 64 and order.LEVEL_BITS <= 19


def test_blocks_of_sparse_orders(spark):
    rng = random.Random(3)
    orders = _sparse_orders(400, 7)
    lists = [[rng.randrange(2, 99) for _ in range(rng.choice([0, 1, 7, 24, 100]))] for _ in orders]
    rows = [(o, ids, len(ids)) for o, ids in zip(orders, lists)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), IDS).repartition(6)
    assert collected(P.pack_blocks(df, 8)) == plain_blocks(lists, 8)


def test_datasets_pack_separately(spark):
    rows = [(i, "ab"[i % 2], [5] * (i % 7), i % 7) for i in range(100)]
    df = spark.createDataFrame(rows, "ord BIGINT, dataset STRING, ids ARRAY<INT>, n_ids BIGINT")
    blocks = P.pack_blocks(df, 8, keys=("dataset",), blocks_per_shard=3)
    for name in "ab":
        got = collected(blocks.where(F.col("dataset") == name))
        assert got == plain_blocks([r[2] for r in rows if r[1] == name], 8)
    assert blocks.where("shard_idx <> block_id div 3").count() == 0


def test_padding_instead_of_packing(spark):
    lists = [[], [4], [4, 5, 6, 7], [4, 5, 6, 7, 8, 9]]
    got = P.shift_labels(P.pad_blocks(docs_of(spark, lists), 4)).orderBy("ord").collect()
    assert [(list(r["input_ids"]), list(r["labels"]), r["length"]) for r in got] == [
        ([0, 0, 0], [0, 0, 0], 0), ([4, 0, 0], [0, 0, 0], 1), ([4, 5, 6], [5, 6, 7], 3), ([4, 5, 6], [5, 6, 7], 3),
    ]


def test_shift_and_length_with_a_real_zero(spark):
    blocks = spark.createDataFrame([(0, [5, 0, 6, 7, 8])], "block_id BIGINT, tokens ARRAY<INT>")
    row = P.shift_labels(blocks).first()
    assert list(row["input_ids"]) == [5, 0, 6, 7] and list(row["labels"]) == [0, 6, 7, 8] and row["length"] == 3


@pytest.mark.parametrize("n, val, wanted", [(1, 0, 1), (2, 0, 1), (20, 0, 1), (39, 0, 1), (40, 0, 2), (21, 4, 4)])
def test_shard_split_counts(spark, n, val, wanted):
    rows = split_shards(spark.range(n).withColumnRenamed("id", "shard_idx"), 0.05, val).collect()
    for split, size in (("val", wanted), ("train", n - wanted)):
        assert sorted(r["split_idx"] for r in rows if r["split"] == split) == list(range(size))


def test_block_split_is_stable_and_near_the_fraction(spark):
    blocks = spark.range(20000).withColumnRenamed("id", "block_id")
    first = split_blocks(blocks.repartition(7), 0.05).where("split = 'val'")
    again = split_blocks(blocks.repartition(3), 0.05).where("split = 'val'")
    assert {r["block_id"] for r in first.collect()} == {r["block_id"] for r in again.collect()}
    assert 800 < first.count() < 1200


@pytest.mark.parametrize("fraction", [0.0, 0.25, 0.5, 0.99])
def test_position_split_slices_the_border_document(spark, fraction):
    lists = [[9] * n for n in (3, 0, 10, 5)]
    stream = [t for ids in lists for t in [*ids, 1]]
    cut = int(len(stream) * (1.0 - fraction))
    parts = split_position(docs_of(spark, lists), fraction, len(stream)).collect()
    for split, wanted in (("train", stream[:cut]), ("val", stream[cut:])):
        rows = sorted((r["start"], list(r["ids"])) for r in parts if r["split"] == split)
        assert [t for _, ids in rows for t in ids] == wanted
        assert all(start == sum(len(ids) for _, ids in rows[:i]) for i, (start, _) in enumerate(rows))


def test_one_long_document(spark):
    text = "0123456789" * 200_000
    df = spark.createDataFrame([(0, text)], "ord BIGINT, text STRING")
    blocks = P.pack_blocks(df, 1024, ByteTokenizer())
    assert blocks.count() == -(-(len(text) + 1) // 1025)
    assert blocks.where(F.size("tokens") != 1025).count() == 0


def test_no_single_task_window_over_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("ord"), "text")
    plan = P.pack_blocks(df, 64, ByteTokenizer())._jdf.queryExecution().executedPlan().toString()
    single = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert len(single) == 1 and "text" not in single[0]  # the totals of the last level only


def test_python_workers_take_batches_bounded_by_bytes(spark):
    from pyspark.sql import functions as F
    from blockloom.operators.packing import cut_pieces
    from blockloom.session import BATCH_BYTES
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(4000, numPartitions=1).select((F.col("id") * 4097).alias("start"), F.repeat(F.lit("a"), 4096).alias("text"))
    pieces = cut_pieces(docs, 1025, (), 1)
    sizes = docs.mapInArrow(lambda batches: (b.select(["start"]).slice(0, 1) for b in batches), "start long").count()
    assert sizes >= 4000 * 4096 // BATCH_BYTES
    assert pieces.agg(F.sum(F.size("part"))).first()[0] == 4000 * 4097
