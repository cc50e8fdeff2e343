"""The pipeline's stages on the smallest given table."""

from __future__ import annotations

import random
import re
import time

import corpus_pipeline
import pyarrow as pa
from blockloom.llm import encoding, shingles, simhash, tokenfile, toxicity
from blockloom.llm.queries import TOKENIZER
from blockloom.session import BATCH_BYTES, SHUFFLE_CLEANUP, materialize
from tests.llm import reference

SF = "/root/testdata/sf0.001"


def _shingles(text):
    """The set of runs of five words."""
    w = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF)
    ids = {r["doc_id"] for r in clean.collect()}
    assert ids == {i for i in text if not scores[i]} and clean.columns == docs.columns
    single = stages["simhash_near_dedup"](spark, clean, SF)
    sets = {i: _shingles(text[i]) for i in ids}
    kept = {r["doc_id"] for r in single.collect()}
    assert kept == set(reference.roots(ids, lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])).values())
    free = stages["benchmark_decontamination"](spark, single, SF)
    left = {r["doc_id"] for r in free.collect()}
    assert left <= kept and {i for i in kept if any(t in text[i] for t in items)} <= kept - left
    mixed = stages["mixing"](spark, free, SF)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= left
    coded = stages["token_ids"](spark, mixed, SF).collect()
    assert len(coded) == mixed.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_near_duplicates_at_five_words(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "a b", "A  b", "a b c"]
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([40, 200, 200]))
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 5):
            near = list(base)
            for at in rng.sample(range(len(near)), edits):
                near[at] = rng.choice(words)
            texts.append(" ".join(near))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    want = reference.roots(range(len(texts)), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs.where("false"), SF).count() == 0


def test_near_duplicates_go_through_simhash(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "a b", "A  b", "a b c"]
    for _ in range(8):
        base = rng.choices(words, k=300)
        for edits in range(4):
            near = list(base)
            for at in rng.sample(range(len(near)), edits):
                near[at] = rng.choice(words)
            texts.append(" ".join(near))
    prints = {simhash.fingerprint((t or "").encode()) for t in texts}
    found = []
    plain = simhash.links

    def noted(fps, bits=simhash.BITS):
        found.extend((r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in plain(fps, bits).collect())
        return plain(fps, bits)

    monkeypatch.setattr(simhash, "links", noted)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, SF)
    sets = [_shingles(t) for t in texts]
    want = reference.roots(range(len(texts)), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    near = {frozenset((a, b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= simhash.BITS}
    assert near and {frozenset(pair) for pair in found} == near

    rows = shingles.with_set_ids(docs)
    pairs = shingles.simhash_pairs(rows, shingles.distinct_sets(rows, shingles.cell_counts(rows))).collect()
    print_of = {r["set_id"]: r["fp"] & (1 << 64) - 1 for r in rows.collect()}
    groups = reference.roots(prints, lambda a, b: (a ^ b).bit_count() <= simhash.BITS)
    assert pairs and all(r["a"] < r["b"] and groups[print_of[r["a"]]] == groups[print_of[r["b"]]] for r in pairs)


def test_copies_of_one_text_meet_it_and_not_each_other(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base)]
    for _ in range(80):
        near = list(base)
        for at in rng.sample(range(len(near)), 5):
            near[at] = f"x{rng.randrange(10 ** 6)}"
        texts.append(" ".join(near))
    rng.shuffle(texts)
    sets = [_shingles(t) for t in texts]
    want = reference.roots(range(len(texts)), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    asked, plain = {}, shingles._verified

    def noted(rows, pairs, label):
        asked[label] = pairs.distinct().count()
        return plain(rows, pairs, label)

    monkeypatch.setattr(shingles, "_verified", noted)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert asked["shingle-near"] + asked["shingle-other"] < len(texts) ** 2 // 8  # all pairs are four times as many


def test_pairs_meet_only_where_the_rest_is_enough(spark):
    # Sets of 9 that first share place 2 keep 7 shingles at most, where 8 are needed.
    index = spark.createDataFrame(
        [(1, 9, 1, 1, 7), (2, 9, 2, 1, 7), (1, 9, 1, 2, 8), (2, 9, 2, 2, 8), (3, 9, 3, 2, 9), (4, 9, 4, 2, 9)],
        "set_id long, n int, group long, at int, run long")
    assert [tuple(r) for r in shingles.prefix_pairs(index).collect()] == [(1, 2)]


def test_token_workers_hold_little(spark, monkeypatch):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(0, "a b")], "doc_id long, text string")
    assert tokenfile.tokenized(docs, TOKENIZER).count() == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == BATCH_BYTES
    sizes, plain = [], encoding.Encoder._slice
    monkeypatch.setattr(encoding.Encoder, "_slice", lambda self, data, borders: sizes.append(data.size) or plain(self, data, borders))
    texts = pa.array([f"word{i % 50} " * 2000 for i in range(400)])
    ids, counts = encoding.encoder(TOKENIZER).encode(texts)
    assert counts.sum() == ids.size and sum(sizes) == sum(len(t) for t in texts.to_pylist()) and max(sizes) < 1 << 21


def test_written_tables_leave_no_shuffle_files(spark):
    def blocks():
        root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {b.name() for b in (found.apply(i) for found in [root.getAllBlocks()] for i in range(found.size()))
                if b.name().startswith("shuffle_")}

    before = blocks()
    rows = materialize(spark.range(10_000).repartition(5, "id").groupBy("id").count(), "gone")
    for _ in range(50):
        if blocks() <= before:
            break
        time.sleep(0.2)
    assert blocks() <= before and rows.count() == 10_000
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"
