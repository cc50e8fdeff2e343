"""What must not grow with the input: broadcasts, and what lies on disk at once."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from blockloom.llm import lines, shingles, simhash
from blockloom.session import materialize


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_of_fingerprints_are_never_broadcast(spark):
    """Spark takes the index, 70 rows per fingerprint, for as small as the file of fingerprints."""
    fps = materialize(spark.range(2000).select(F.xxhash64("id").alias("fp")), "test-prints")
    found = simhash.links(fps)
    assert "Broadcast" not in plan_of(found) and "SortMergeJoin" in plan_of(found)
    near = fps.limit(5).select("fp", (F.col("fp").bitwiseXOR(F.lit(0x0101))).alias("other")).collect()
    more = spark.createDataFrame([(r["other"],) for r in near], "fp long").unionByName(fps).distinct()
    pairs = {(r["a"], r["b"]) for r in simhash.links(materialize(more, "test-prints")).collect()}
    assert {(min(r["fp"], r["other"]), max(r["fp"], r["other"])) for r in near} <= pairs


def test_long_sets_that_differ_are_not_verified(spark, monkeypatch):
    """A sketch of 64 bits is full for a hundred words and more; pairs that share a few must not move as whole sets."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(400)]
    texts = [" ".join(rng.sample(common, 150)) for _ in range(60)]
    texts += [t.replace("c7 ", "x ") for t in texts[:8]] + [" ".join(t.split(" ")[:130]) for t in texts[8:16]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    moved, verified = [], lines._verified
    monkeypatch.setattr(lines, "_verified", lambda docs, pairs, label: (moved.append(pairs.distinct().count()), verified(docs, pairs, label))[1])
    found = {r["doc_id"] for r in lines.repeated_lines(table).where("n_removed > 0").collect()}
    sets = [frozenset(t.split(" ")) for t in texts]
    alike = [(j, i) for i, s in enumerate(sets) for j in range(i) if len(s & sets[j]) * 5 >= len(s | sets[j]) * 4]
    assert found == {i for _, i in alike} and len(found) >= 16
    assert sum(moved) <= 2 * len(alike)


def test_postings_of_words_move_once(spark):
    """Both sides of the join read one shuffle, and no side is broadcast."""
    rows = spark.range(400).selectExpr(
        "id AS set_id", "5 AS n", "id * 977 AS sketch", "id * 2 AS order", "0 AS at", "CAST(id % 20 AS INT) AS word")
    pairs = lines.posting_pairs(materialize(rows, "test-postings"))
    pairs.collect()
    plan = plan_of(pairs)
    assert "ReusedExchange" in plan and "Broadcast" not in plan


def test_postings_of_shingles_are_never_broadcast(spark):
    """The files of postings are far smaller than their rows, so their size must not decide."""
    rows = spark.range(400).selectExpr("id AS set_id", "5 AS n", "id AS group", "0 AS at", "id % 20 AS run")
    plan = plan_of(shingles.prefix_pairs(materialize(rows, "test-postings")))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
