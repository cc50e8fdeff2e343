"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has one byte per position. Two fingerprints with at most ``bits`` differing bits differ in at most as
many bytes, so they share at least ``positions - bits`` positional bytes. The index posts every distinct fingerprint
under each choice of that many positions and the bytes there: a pair meets under a choice exactly when its tally of
shared bytes reaches the minimum. It is kept at the first choice it shares, and only if its bits verify, all inside one
equi-join. Groups are the connected components of the links.

Defined results: a null text has no words, as an empty one, and its fingerprint is zero; rows with equal fingerprints
are linked; a null ``doc_id`` is never the smallest unless all ids of its group are null; repeated rows share a group;
an empty table gives an empty result. Other columns, whatever their names, pass through unchanged; a very long text is
hashed by one task, shingle by shingle.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import numbered, text_of
from blockloom.session import materialize

SHINGLE = 4
BITS = 4
SEED = 42
POSITIONS = 8
SLICE = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text over its word shingles, repeats included."""
    words = text.lower().split()  # bytes: lowers A-Z only and splits at ASCII white space only
    if not words:
        return 0
    last = max(1, len(words) - shingle + 1)
    hashed = np.fromiter(
        (xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), SEED) for i in range(last)), np.uint64, last)
    ones = np.zeros(64, np.int64)
    for i in range(0, last, SLICE):
        part = hashed[i:i + SLICE, None].view(np.uint8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view(np.uint64)[0])


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE) -> pa.Array:
    """The fingerprints of binary texts, as signed 64 bits."""
    made = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
    return pa.array(made.view(np.int64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, columns: list[Column] | None = None) -> DataFrame:
    """The written table of ``_row``, the columns (``doc_id`` unless given) and ``fp`` (signed 64 bits)."""
    @F.arrow_udf("long")
    def each(texts: pa.Array) -> pa.Array:
        return fingerprints_of(texts, shingle)

    kept = columns or [F.col("doc_id").cast("long").alias("doc_id")]
    return materialize(numbered(docs.select(*kept, each(text_of().cast("binary")).alias("fp"))), "simhash")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(255)


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """``a, b`` with ``a < b``: all pairs of distinct fingerprints at ``bits`` or fewer differing bits."""
    choices = list(combinations(range(POSITIONS), POSITIONS - bits))
    postings = []
    for number, choice in enumerate(choices):
        key = F.lit(number).cast("long")
        for position in choice:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(F.col("fp"), position))
        postings.append(F.struct(key.alias("key"), F.lit(number).alias("choice")))
    index = fps.select("fp", F.explode(F.array(*postings)).alias("p")).select("fp", "p.key", "p.choice")
    left, right = index.select("key", "choice", F.col("fp").alias("a")), index.select("key", F.col("fp").alias("b"))
    # Choices are in lexicographic order, so the first choice a pair shares is its first shared positions.
    shared = [(_byte(F.col("a"), p) == _byte(F.col("b"), p)) for p in range(POSITIONS)]
    need = POSITIONS - bits
    seen, first = F.lit(0), F.lit(0)
    for position, same in enumerate(shared):
        first = first + F.when(same & (seen < need), 1 << position).otherwise(0)
        seen = seen + same.cast("int")
    mask = F.element_at(F.array(*[F.lit(sum(1 << p for p in c)) for c in choices]), F.col("choice") + 1)
    # Spark sizes the index as the fingerprints, not as their 70 postings each, and would broadcast it.
    pairs = left.join(right.hint("merge"), (left["key"] == right["key"]) & (F.col("a") < F.col("b"))
                      & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits) & (first == mask))
    return pairs.select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that has an edge: the smallest node it is connected to.

    Alternates large-star and small-star steps. Each step's edges are written, so no lineage grows and a lost executor
    costs one step; the number of edges never grows.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        small = materialize(small, "small-star")
        # Done when every node hangs from one root and no root hangs from another.
        if small.groupBy("u").count().where("count > 1").isEmpty() and small.join(
                small.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                small.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges = small


def near_groups(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """Per row: ``_row, doc_id, fp, component_id``, the smallest ``doc_id`` of its group."""
    return grouped(fingerprints(docs, shingle), bits)


def grouped(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """Add ``root``, which names the group, and ``component_id`` to rows with ``_row, doc_id, fp``."""
    # One row per fingerprint; written, so that joins with the rows deal out both sides and hot ones can be split.
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = materialize(components(links(fps.select("fp"), bits)), "roots")
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(ids, "root").select("fp", "root", "component_id"), "components")
    return rows.join(named, "fp")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The documents with one row of each group left, unchanged: the smallest ``doc_id``, one of its repeated rows.

    The documents are written with their fingerprints, so both reads see the same rows; the texts do not move unless
    too many rows go for a broadcast of their numbers.
    """
    rows = fingerprints(docs, shingle, [F.struct("*").alias("_doc")])
    found = grouped(rows.select("_row", F.col("_doc.doc_id").cast("long").alias("doc_id"), "fp"), bits)
    return first_of_each(rows, found).select("_doc.*")


def first_of_each(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows without those that another row of the same ``root`` precedes; ``found`` has ``_row, doc_id, root``."""
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    best = materialize(found.groupBy("root").agg(F.min(place).alias("best")), "near-best")
    gone = found.select("_row", "root").join(best, "root").where(F.col("_row") != F.col("best._row")).select("_row")
    return rows.join(materialize(gone, "near-gone"), "_row", "left_anti")
