"""Near duplicates by SimHash, then by the exact Jaccard similarity of word shingles.

A document is its set of distinct runs of five words, lower case in A-Z; a shorter one is the run of all its words.
All pairs at similarity 0.8 or more are linked, by the set join of ``lines``: shingles are ordered by their count over
all documents, rarest first, only the prefixes that two such sets must share are posted, and pairs that meet and pass
the filters by length and place are verified on whole sets. Groups are the connected components of the links.

SimHash groups (``simhash``) come first: each set of one is verified against the group's first set. SimHash alone cannot
promise all pairs: at this similarity two 64-bit fingerprints differ in about ten bits on average, beyond any limit a
byte index covers. So each set is verified against the central set of those with the same least hash as well, the one whose
posted shingles are in the most sets, and the join over all prefixes finds the rest. Sets which the first two connect are not
paired again. Copies of one text, each edited in its own way, resemble the text more than each other, so a large group of
them is connected by its central set and yields few pairs.

The join lets a pair pass only where what follows in both sets, the shingle they meet under included, is enough for the
similarity. A pair that reaches it passes at the first shingle the two share, so none is lost.

Shingles are made from the texts wherever they are needed, and told apart by 64-bit hashes.

Defined results: a null text has no words, as an empty one, and all such documents are one group; repeated rows share a
group; a null ``doc_id`` is never the smallest unless all ids of its group are null; an empty table gives an empty
result. Other columns, whatever their names, pass through unchanged. The distinct shingles of one document are held by one
task, in some twelve bytes per byte of its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm import bitmaps, simhash
from blockloom.llm.common import numbered, text_of
from blockloom.llm.encoding import text_slices
from blockloom.llm.lines import (
    _BASE, COUNT_CELLS, SIMILARITY, SLICE_BYTES, _cell, _enough, _list_array, _mixed, _moved, _per_set, _set_ids,
    _Unsent, word_hashes)
from blockloom.llm.simhash import components, first_of_each
from blockloom.session import discard, materialize, passing_shuffles, small_batches

SHINGLE = 5
#: Least hashes of a set under so many orders; sets meet a central set by the first ``KEYS`` of them and are compared
#: with it if ``AGREEING`` of all are the same. Whatever that passes over is left to the join over all prefixes.
ORDERS = tuple(pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(1, 9))
KEYS, AGREEING = 3, 5
#: Pairs are verified in so many parts, one after the other, so that less lies on disk at once.
PARTS = 4


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive parts of the texts, some hundred kilobytes or one longer text each."""
    return text_slices(texts, SLICE_BYTES)


def _shingle_sets(texts: pa.Array, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The set size of each text, and the shingle hashes of all sets, one set after the other.

    The shingles of a set go by hash or, with the place of each hash cell, by the place of their cells and hash.
    """
    words, owner = word_hashes(texts, lower=True)
    words = np.append(words, np.zeros(SHINGLE, np.uint64))
    whose = np.append(owner, np.full(SHINGLE, -1))
    runs = np.zeros(owner.size, np.uint64)
    for j in range(SHINGLE):  # words beyond the end of the text count as none
        runs = runs * np.uint64(_BASE) + np.where(whose[j:j + owner.size] == owner, words[j:j + owner.size], np.uint64(0))
    counts = np.bincount(owner, minlength=len(texts))
    at = np.arange(owner.size) - np.repeat(np.cumsum(counts) - counts, counts)
    full = at < np.maximum(1, counts - SHINGLE + 1)[owner]
    runs, owner = _mixed(runs[full]), owner[full]
    if places is not None:
        runs = _moved(runs, places)
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    new = np.ones(runs.size, bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    runs, owner = runs[new], owner[new]
    if places is not None:
        runs = _moved(runs, np.argsort(places))
    return np.bincount(owner, minlength=len(texts)), runs


def with_set_ids(docs: DataFrame) -> DataFrame:
    """The written table ``_doc, set_id, fp, _row``: each document as it is, in a column of its own; equal sets have equal ids.

    ``fp`` is the SimHash of the text.
    """
    @F.arrow_udf("struct<set_id: bigint, fp: bigint>")
    def each(texts: pa.Array) -> pa.Array:
        parts = [_set_ids(*_shingle_sets(part)) for part in _slices(texts)]
        ids = pa.array(np.concatenate([np.zeros(0, np.int64), *parts]))
        data = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
        return pa.StructArray.from_arrays([ids, simhash.fingerprints_of(data)], names=["set_id", "fp"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("_doc"), each(text_of()).alias("_made"))
    return materialize(numbered(rows.select("_doc", "_made.set_id", "_made.fp")), "shingle-rows")


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select(text_of("_doc.text").alias("text"))


def cell_counts(rows: DataFrame) -> np.ndarray:
    """Counts of shingles by hash cell, over all documents."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNT_CELLS, np.int64)
        for batch in batches:
            for part in _slices(batch.column(0)):
                total += np.bincount(_cell(_shingle_sets(part)[1]), minlength=COUNT_CELLS)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "count"])

    with passing_shuffles(rows.sparkSession):
        sums = _texts(rows).mapInArrow(each, "cell long, count long").groupBy("cell").agg(F.sum("count").alias("count"))
        found = sums.toPandas()  # at most COUNT_CELLS numbers, whatever the input
    result = np.zeros(COUNT_CELLS, np.int64)
    result[found["cell"].to_numpy(np.int64)] = found["count"].to_numpy(np.int64)
    return result


def distinct_sets(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """The written table ``set_id, n, least, prefix``: each distinct set once, with its prefix shingles, rarest first."""
    places = np.empty(COUNT_CELLS, np.int64)
    places[np.argsort(counts, kind="stable")] = np.arange(COUNT_CELLS)
    known = rows.sparkSession.sparkContext.broadcast(places)
    over, under = SIMILARITY

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unsent = _Unsent()
        for batch in batches:
            for part in _slices(batch.column(0)):
                sizes, runs = _shingle_sets(part, known.value)
                ids = _set_ids(sizes, runs)
                least = np.stack([_per_set(sizes, runs * np.uint64(m), np.minimum) for m in ORDERS], axis=1).view(np.int64)
                new = unsent(sizes, ids)
                prefix = np.where(new, sizes - (over * sizes + under - 1) // under + 1, 0)
                at = np.arange(runs.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                posted = runs[at < np.repeat(prefix, sizes)].view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[new]), pa.array(sizes[new].astype(np.int32)),
                    _list_array(np.full(new.sum(), len(ORDERS)), pa.array(least[new].ravel())),
                    _list_array(prefix[new], pa.array(posted))], ["set_id", "n", "least", "prefix"])

    sets = _texts(rows).mapInArrow(each, "set_id long, n int, least array<long>, prefix array<long>")
    return materialize(sets.dropDuplicates(["set_id"]), "shingle-sets")


def shingles_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The written table ``set_id, runs``: the shingle hashes of the wanted sets, each from one of its rows."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch.column(0)):
                sizes, runs = _shingle_sets(part)
                yield pa.RecordBatch.from_arrays([
                    pa.array(_set_ids(sizes, runs)), _list_array(sizes, pa.array(runs.view(np.int64)))], ["set_id", "runs"])

    firsts = rows.join(wanted, "set_id", "left_semi").groupBy("set_id").agg(F.min("_row").alias("_row")).select("_row")
    chosen = rows.join(firsts, "_row", "left_semi")
    return materialize(_texts(chosen).mapInArrow(each, "set_id long, runs array<long>"), "shingle-runs")


def _verified(rows: DataFrame, pairs: DataFrame, label: str) -> DataFrame:
    """The written pairs ``a, b`` that reach the similarity."""
    pairs = materialize(pairs.distinct(), f"{label}-pairs")
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), f"{label}-wanted")
    runs = shingles_of(rows, wanted)
    found = []
    for part in range(PARTS):  # the sets that move for a part are gone before the next one; by b, as one a may be in most pairs
        mine = lambda column: F.pmod(F.xxhash64(column), F.lit(PARTS)) == part
        found.append(materialize(
            pairs.where(mine("b")).join(runs.select(F.col("set_id").alias("a"), F.col("runs").alias("ra")), "a")
            .join(runs.where(mine("set_id")).select(F.col("set_id").alias("b"), F.col("runs").alias("rb")), "b")
            .where(_enough(F.size("ra"), F.size("rb"), F.size(F.array_intersect("ra", "rb")))).select("a", "b"), label))
    for table in (runs, wanted, pairs):
        discard(table)
    return reduce(DataFrame.unionByName, found)


def postings(sets: DataFrame) -> DataFrame:
    """``set_id, n, at, run``: the prefix shingles that occur in two sets or more, as far as a bitmap of them can tell.

    A shingle of one set alone meets nothing, and most are such. What the bitmap lets through besides finds no partner.
    """
    known = sets.sparkSession.sparkContext.broadcast(bitmaps.repeated(sets.select("prefix")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, at, runs = bitmaps.shared_items(batch.column(2), known.value)
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at), pa.array(runs)],
                ["set_id", "n", "at", "run"])

    return sets.select("set_id", "n", "prefix").mapInArrow(each, "set_id long, n int, at int, run long")


def _lengths_fit(n: Column, m: Column) -> Column:
    """Whether sets of such sizes can reach the similarity."""
    over, under = SIMILARITY
    return (n * under >= m * over) & (m * under >= n * over)


def simhash_pairs(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: each set of a SimHash group with the first set of the group, if their sizes allow the similarity."""
    grouped = simhash.grouped(rows.select("_row", F.col("_doc.doc_id").cast("long").alias("doc_id"), "fp", "set_id"))
    found = grouped.select("root", "set_id").distinct().join(sets.select("set_id", "n"), "set_id")
    first = found.groupBy("root").agg(F.min(F.struct("set_id", "n")).alias("first"))
    return found.join(first, "root").where((F.col("set_id") != F.col("first.set_id")) & _lengths_fit(F.col("n"), F.col("first.n"))).select(
        F.col("first.set_id").alias("a"), F.col("set_id").alias("b"))


def central_pairs(sets: DataFrame, posted: DataFrame) -> DataFrame:
    """``a, b``: each set with the central one of those with the same least hash, if enough of their least hashes agree.

    The central set is the one whose posted shingles are in the most sets; sets that share none of theirs are in no pair.
    """
    common = posted.groupBy("run").agg(F.count("*").alias("c")).where("c > 1")
    shared = materialize(posted.hint("merge").join(common, "run").groupBy("set_id").agg(F.sum("c").alias("shared")), "shingle-shared")
    keyed = sets.join(shared, "set_id").select("set_id", "n", "least", "shared", F.explode(F.slice("least", 1, KEYS)).alias("key"))
    central = keyed.groupBy("key").agg(F.max(F.struct("shared", "set_id", "n", "least")).alias("e"))
    same = F.size(F.filter(F.zip_with("least", "e.least", lambda x, y: x == y), lambda x: x))
    return keyed.join(central, "key").where(
        (F.col("e.set_id") != F.col("set_id")) & _lengths_fit(F.col("n"), F.col("e.n")) & (same >= AGREEING)
    ).select(F.col("e.set_id").alias("a"), F.col("set_id").alias("b"))


def prefix_pairs(index: DataFrame) -> DataFrame:
    """``a, b``: the sets of different groups that meet under a posted shingle, and may match if it is their first."""
    left, right = (index.select("run", *[F.col(c).alias(c + side) for c in ("set_id", "n", "group", "at")]) for side in "ab")
    na, nb = F.col("na"), F.col("nb")
    rest = F.least(na - F.col("ata"), nb - F.col("atb"))
    # A posting's columns repeat from row to row, so the table's files are far smaller than a broadcast of it.
    pairs = left.join(right.hint("merge"), (left["run"] == right["run"]) & (F.col("set_ida") < F.col("set_idb"))
                      & (F.col("groupa") != F.col("groupb")) & _enough(na, nb, rest))
    return pairs.select(F.col("set_ida").alias("a"), F.col("set_idb").alias("b"))


def links(rows: DataFrame) -> DataFrame:
    """``a, b``: verified pairs of set ids whose components are those of all pairs that reach the similarity."""
    sets = distinct_sets(rows, cell_counts(rows))
    posted = materialize(postings(sets), "shingle-posted")
    near = _verified(rows, simhash_pairs(rows, sets).unionByName(central_pairs(sets, posted)), "shingle-near")
    discard(sets)

    joined = materialize(components(near), "shingle-joined")
    index = posted.join(joined, F.col("set_id") == F.col("node"), "left").select(
        "set_id", "n", F.coalesce("root", "set_id").alias("group"), "at", "run")
    index = materialize(index, "shingle-postings")
    discard(posted)
    others = _verified(rows, prefix_pairs(index), "shingle-other")
    for table in (index, joined):
        discard(table)
    return near.unionByName(others)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with one row of each group left, unchanged: the smallest ``doc_id``, one of its repeated rows."""
    rows = with_set_ids(docs)
    roots = materialize(components(links(rows)), "shingle-roots")
    found = rows.select("_row", F.col("_doc.doc_id").cast("long").alias("doc_id"), "set_id").join(
        roots, F.col("set_id") == F.col("node"), "left").select("_row", "doc_id", F.coalesce("root", "set_id").alias("root"))
    return first_of_each(rows, found).select("_doc.*")
