"""Near-duplicate lines by an exact set-similarity join.

A line is its set of distinct words. The words of a line are ordered by their count over all lines, rarest first (the
counts of ``COUNT_CELLS`` hash cells, ties by hash: any one order for all lines is exact). Two sets of ``n`` and ``m``
words with Jaccard similarity ``t`` or more share a word among their first ``n - ceil(t n) + 1`` and
``m - ceil(t m) + 1``, so only these prefixes are posted. Pairs that meet are filtered by length, by what their places
still allow, and by a sketch: bit ``h mod 64`` flips for every word of a set, so two sketches differ in at most as many
bits as their sets differ in words. Such a sketch of 64 bits is full for sets of a hundred words, so pairs of sets of more
than ``WIDE_FROM`` words are filtered by a wider one as well. The rest is verified on whole sets. A line goes when an earlier line, by document id
and place, matches it. Lines with equal sets are one set throughout, so copies are never paired with each other. Of a
large group of near copies most need one look: each set is first compared with the earliest set of the same least hash,
and only sets that no such set matches look for an earlier one among all.

The words of lines are made from the texts wherever they are needed, and never written for all lines.

Defined results: a null text counts as empty; lines without words are kept; a ``doc_id`` that is no whole number comes
last; repeated rows follow each other in any order, and of equal lines the first stays; an empty table gives an empty
result. Words and sets are told apart by 64-bit hashes. Other columns are not read, whatever their names. Long texts are walked by
lines and long lines by words, some hundred kilobytes at a time; a task holds the distinct words of one line.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.llm import bitmaps
from blockloom.llm.common import numbered, stream_starts, text_of
from blockloom.llm.encoding import buffers, text_slices
from blockloom.session import discard, materialize, passing_shuffles

SIMILARITY = (4, 5)
CELL_SHIFT = 46
COUNT_CELLS = 1 << 64 - CELL_SHIFT
COUNT_PART = 1 << 12
#: Bytes that are hashed at once: small enough for a processor's cache.
SLICE_BYTES = 1 << 18
#: Added to the places of lines whose document has no whole-number id.
LAST = 1 << 60
#: Sets a task remembers to have sent; it forgets them when full, which changes no result.
KNOWN_SETS = 500_000
#: Least hashes by which a set meets an earliest set; more of them leave fewer sets to the join over all.
LEAST = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Sets of more words have a wide sketch, of so many times 64 bits.
WIDE_FROM, WIDE = 48, 8
#: Postings are joined, and pairs verified, in so many parts, one after the other, so that less lies on disk at once.
PARTS = 4


_IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.Generator(np.random.PCG64(1)).integers(1, 1 << 64, 256, np.uint64)


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` for ``i < n``, in 64 bits."""
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random values of its bytes, then mixed.

    Words are hashed some megabytes at a time, all at once from running sums.
    """
    result = np.empty(starts.size, np.uint64)
    cuts = np.flatnonzero(np.diff(starts // SLICE_BYTES)) + 1
    for i, j in zip([0, *cuts], [*cuts, starts.size]):
        if j > i:
            low, high = starts[i], ends[j - 1]
            size = 1 << int(high - low).bit_length()
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTES[data[low:high]] * _powers(_BASE, size)[:high - low], out=sums[1:])
            back = _powers(pow(_BASE, -1, 1 << 64), size)
            result[i:j] = (sums[ends[i:j] - low] - sums[starts[i:j] - low]) * back[starts[i:j] - low]
    return _mixed(result)


def _line_slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """The lines of texts, some hundred kilobytes at a time: the text of each line, its place there, and the lines."""
    done = 0
    for part in text_slices(texts, SLICE_BYTES):
        lists = pc.split_pattern(part, "\n")
        sizes = np.diff(lists.offsets.to_numpy())
        lines = lists.flatten()
        owner = np.repeat(np.arange(sizes.size), sizes)
        place = np.arange(owner.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        start = 0
        for some in text_slices(lines, SLICE_BYTES):
            stop = start + len(some)
            yield done + owner[start:stop], place[start:stop], some
            start = stop
        done += len(part)


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts, and which text it is in; ``lower`` takes A-Z as a-z.

    The bytes are walked in windows that end between two words, so a long text takes no more memory than its words.
    """
    data, offsets = buffers(texts)
    at, hashes, owners = 0, [], []
    while at < data.size:
        end, reach = data.size, SLICE_BYTES
        while at + reach < data.size and end == data.size:
            gaps = np.flatnonzero(_IS_SPACE[data[at + 1:at + reach]])
            border = offsets[np.searchsorted(offsets, at + reach) - 1]
            last = max(at + 1 + int(gaps[-1]) if gaps.size else 0, int(border))
            end, reach = last if last > at else end, reach * 4
        window = data[at:end]
        if lower:
            window = np.where((window >= 65) & (window <= 90), window + np.uint8(32), window)
        inside = ~_IS_SPACE[window]
        edge = np.zeros(window.size + 1, bool)  # where a text starts or ends
        edge[offsets[np.searchsorted(offsets, at):np.searchsorted(offsets, end, "right")] - at] = True
        edge[0] = edge[-1] = True
        starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])))
        ends = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))) + 1
        hashes.append(_hashed(window, starts, ends))
        owners.append(np.searchsorted(offsets, starts + at, "right") - 1)
        at = end
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int64), *owners])


def _word_sets(lines: pa.Array, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The set size of each line, and the word hashes of all sets, one set after the other.

    The words of a set go by hash or, with the place of each hash cell, by the place of their cells and hash.
    """
    words, owner = word_hashes(lines)
    if places is not None:
        words = _moved(words, places)
    order = np.argsort(words)
    words = words[order]
    new = np.diff(words, prepend=~words[:1]) != 0
    rank = np.cumsum(new) - 1
    bits = int(rank.size).bit_length()
    keys = (owner[order] << bits) + rank
    keys.sort()
    keys = keys[np.diff(keys, prepend=-1) > 0]
    words = words[new][keys & ((1 << bits) - 1)]
    if places is not None:
        words = _moved(words, np.argsort(places))
    return np.bincount(keys >> bits, minlength=len(lines)), words


def _cell(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(CELL_SHIFT)).astype(np.int64)


def _moved(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The hashes with their cells, the upper bits, replaced by the places of the cells."""
    return places[_cell(words)].astype(np.uint64) << np.uint64(CELL_SHIFT) | words & np.uint64((1 << CELL_SHIFT) - 1)


def _per_set(sizes: np.ndarray, values: np.ndarray, combine: np.ufunc) -> np.ndarray:
    """The values of each set combined; 0 for an empty set."""
    result = np.zeros(sizes.size, np.uint64)
    held = sizes > 0
    if held.any():
        result[held] = combine.reduceat(values, (np.cumsum(sizes) - sizes)[held])
    return result


def _set_ids(sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
    return _per_set(sizes, words, np.add).view(np.int64)


def _list_array(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(text_of().alias("text"))


def line_sets(docs: DataFrame) -> DataFrame:
    """The written table ``_row, doc_id, line, n, set_id``: each line with the number of its distinct words."""
    rows = numbered(docs.select("doc_id", text_of().alias("text"))).select("_row", "doc_id", "text")
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("line", T.IntegerType()),
                           T.StructField("n", T.IntegerType()), T.StructField("set_id", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, place, lines in _line_slices(batch.column(2)):
                sizes, words = _word_sets(lines)
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(at), batch.column(1).take(at), pa.array(place.astype(np.int32)),
                    pa.array(sizes.astype(np.int32)), pa.array(_set_ids(sizes, words))],
                    ["_row", "doc_id", "line", "n", "set_id"])

    return materialize(rows.mapInArrow(each, schema), "line-sets")


def word_counts(docs: DataFrame) -> np.ndarray:
    """Counts of words by hash cell, over all lines. Tasks send their counts in parts, so no task adds up all cells."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNT_CELLS, np.int64)
        for batch in batches:
            for _, _, lines in _line_slices(batch.column(0)):
                total += np.bincount(_cell(_word_sets(lines)[1]), minlength=COUNT_CELLS)
        parts = total.reshape(-1, COUNT_PART)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, np.zeros(COUNT_PART, np.int64)
        for batch in batches:
            for name, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = name
                total += np.frombuffer(counts.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])

    with passing_shuffles(docs.sparkSession):
        sums = _texts(docs).mapInArrow(each, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary")
        rows = sums.toArrow().to_pylist()  # COUNT_CELLS numbers, whatever the input
    result = np.zeros(COUNT_CELLS, np.int64)
    for row in rows:
        result[row["part"] * COUNT_PART:(row["part"] + 1) * COUNT_PART] = np.frombuffer(row["counts"], np.int64)
    return result


class _Unsent:
    """Which sets of a slice this task has not sent yet, as far as it remembers."""

    def __init__(self) -> None:
        self.known: set[int] = set()

    def __call__(self, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if len(self.known) > KNOWN_SETS:
            self.known.clear()
        _, first = np.unique(ids, return_index=True)
        new = np.zeros(ids.size, bool)
        new[[i for i in first if sizes[i] and ids[i] not in self.known]] = True
        self.known.update(ids[new].tolist())
        return new


def _wide_sketches(sizes: np.ndarray, words: np.ndarray) -> pa.Array:
    """The wide sketch of each set of more than ``WIDE_FROM`` words, an empty list for the others."""
    long = sizes > WIDE_FROM
    bits = 64 * WIDE
    owner = np.repeat(np.arange(long.sum()), sizes[long])
    cell = (words[np.repeat(long, sizes)] >> np.uint64(6)) % np.uint64(bits)
    flips = np.bincount(owner * bits + cell.astype(np.int64), minlength=int(long.sum()) * bits) & 1
    sketches = np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)
    return _list_array(np.where(long, WIDE, 0), pa.array(sketches))


def distinct_sets(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """``set_id, n, sketch, least, wide, prefix``: each distinct set once, with the 32 bits of its prefix words, rarest first.

    Two words of the same 32 bits only make more pairs meet.
    """
    places = np.empty(COUNT_CELLS, np.int64)
    places[np.argsort(counts, kind="stable")] = np.arange(COUNT_CELLS)
    known = docs.sparkSession.sparkContext.broadcast(places)
    over, under = SIMILARITY

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unsent = _Unsent()
        for batch in batches:
            for _, _, lines in _line_slices(batch.column(0)):
                sizes, words = _word_sets(lines, known.value)
                ids = _set_ids(sizes, words)
                sketch = _per_set(sizes, np.uint64(1) << (words & np.uint64(63)), np.bitwise_xor).view(np.int64)
                least = np.stack([_per_set(sizes, words * np.uint64(m), np.minimum) for m in LEAST], axis=1).view(np.int64)
                new = unsent(sizes, ids)
                prefix = np.where(new, sizes - (over * sizes + under - 1) // under + 1, 0)
                at = np.arange(words.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                posted = words[at < np.repeat(prefix, sizes)].astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[new]), pa.array(sizes[new].astype(np.int32)), pa.array(sketch[new]),
                    _list_array(np.full(new.sum(), len(LEAST)), pa.array(least[new].ravel())),
                    _wide_sketches(sizes[new], words[np.repeat(new, sizes)]),
                    _list_array(prefix[new], pa.array(posted))], ["set_id", "n", "sketch", "least", "wide", "prefix"])

    sets = _texts(docs).mapInArrow(
        each, "set_id long, n int, sketch long, least array<long>, wide array<long>, prefix array<int>")
    return sets.dropDuplicates(["set_id"])


def words_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``set_id, words``: the word hashes of the wanted sets.

    A bitmap of the wanted ids keeps most other sets from leaving Python; the join decides exactly.
    """
    known = docs.sparkSession.sparkContext.broadcast(bitmaps.of(wanted))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unsent = _Unsent()
        for batch in batches:
            for _, _, lines in _line_slices(batch.column(0)):
                sizes, words = _word_sets(lines)
                ids = _set_ids(sizes, words)
                new = bitmaps.has(known.value, ids.view(np.uint64))
                new[new] = unsent(sizes[new], ids[new])
                if new.any():
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[new]), _list_array(sizes[new], pa.array(words[np.repeat(new, sizes)].view(np.int64)))],
                        ["set_id", "words"])

    sets = _texts(docs).mapInArrow(each, "set_id long, words array<long>")
    return sets.join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"])


def _enough(a: Column, b: Column, shared: Column) -> Column:
    """Whether sets of ``a`` and ``b`` words that share so many reach the similarity, in whole numbers."""
    over, under = SIMILARITY
    return shared * (over + under) >= (a + b) * over


def _may_match(na: Column, sketch_a: Column, nb: Column, sketch_b: Column) -> Column:
    """The filters by length and by sketch."""
    over, under = SIMILARITY
    differing = F.bit_count(sketch_a.bitwiseXOR(sketch_b))
    return (na * under >= nb * over) & (nb * under >= na * over) & (differing * (over + under) <= (na + nb) * (under - over))


def _verified(docs: DataFrame, pairs: DataFrame, label: str) -> DataFrame:
    """The written table of the sets ``b`` that reach the similarity with the ``a`` of some pair."""
    pairs = materialize(pairs.distinct(), f"{label}-pairs")
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), f"{label}-wanted")
    words = materialize(words_of(docs, wanted), f"{label}-words")
    matching = []
    for part in range(PARTS):  # by b, so that a set is found once
        mine = lambda column: _part(F.col(column)) == part
        matching.append(materialize((
            pairs.where(mine("b")).join(words.select(F.col("set_id").alias("a"), F.col("words").alias("wa")), "a")
            .join(words.where(mine("set_id")).select(F.col("set_id").alias("b"), F.col("words").alias("wb")), "b")
            .where(_enough(F.size("wa"), F.size("wb"), F.size(F.array_intersect("wa", "wb"))))
        ).select(F.col("b").alias("set_id")).distinct(), f"{label}-matched"))
    for table in (words, wanted, pairs):
        discard(table)
    return reduce(DataFrame.unionByName, matching)


def _part(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(PARTS))


def _resembling(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that their wide sketches allow; ``sketches`` has ``set_id, n, wide`` of the sets with one."""
    over, under = SIMILARITY
    for side in "ab":
        pairs = pairs.join(sketches.select(*[F.col(c).alias(n) for c, n in (("set_id", side), ("n", f"n{side}"), ("wide", f"w{side}"))]), side, "left")
    differing = sum(F.bit_count(F.col("wa")[i].bitwiseXOR(F.col("wb")[i])) for i in range(WIDE))
    fits = differing * (over + under) <= (F.col("na") + F.col("nb")) * (under - over)
    return pairs.where(F.coalesce(fits, F.lit(True))).select("a", "b")


def postings(sets: DataFrame, repeated: np.ndarray) -> DataFrame:
    """``set_id, at, word``: the prefix words that occur in two sets or more, as far as a bitmap of them can tell."""
    known = sets.sparkSession.sparkContext.broadcast(repeated)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
            owner, at, words = bitmaps.shared_items(batch.column(batch.num_columns - 1), known.value)
            rows = rest.take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(at), pa.array(words)], [*rest.schema.names, "at", "word"])

    names = [c for c in sets.columns if c != "prefix"]
    schema = T.StructType([*[sets.schema[c] for c in names], T.StructField("at", T.IntegerType()), T.StructField("word", T.IntegerType())])
    return sets.select(*names, "prefix").mapInArrow(each, schema)


def matched_sets(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """``set_id`` of each set that matches another one with an earlier ``first`` place."""
    sets = materialize(
        distinct_sets(docs, word_counts(docs)).join(firsts.select("set_id", "first"), "set_id"), "line-distinct")
    keyed = sets.select("set_id", "n", "sketch", "first", F.explode("least").alias("key"))
    earliest = keyed.groupBy("key").agg(F.min(F.struct("first", "set_id", "n", "sketch")).alias("e"))
    pairs = keyed.join(earliest, "key").where(
        (F.col("e.first") < F.col("first")) & _may_match(F.col("e.n"), F.col("e.sketch"), F.col("n"), F.col("sketch"))
    ).select(F.col("e.set_id").alias("a"), F.col("set_id").alias("b"))
    sketches = materialize(sets.where(F.size("wide") > 0).select("set_id", "n", "wide"), "line-sketches")
    near = _verified(docs, _resembling(pairs.distinct(), sketches), "line-near")

    repeated = bitmaps.repeated(sets.select("prefix"))
    # The place of a matched set is marked before its words are posted, so postings need not move for it.
    order = (F.col("first") * 2 + F.coalesce("done", F.lit(0))).alias("order")
    marked = sets.join(near.withColumn("done", F.lit(1)), "set_id", "left").select("set_id", "n", "sketch", order, "prefix")
    index = materialize(postings(marked, repeated), "line-postings")
    discard(sets)
    found = [materialize(posting_pairs(index.where(_part(F.col("word")) == part)).distinct(), "line-candidates") for part in range(PARTS)]
    discard(index)
    others = _verified(docs, _resembling(reduce(DataFrame.unionByName, found).distinct(), sketches), "line-other")
    for table in (*found, sketches):
        discard(table)
    return near.unionByName(others)


def posting_pairs(index: DataFrame) -> DataFrame:
    """``a, b``: sets that meet under a posted word and may match, an unmatched one ``b`` with an earlier one ``a``.

    Both sides of the join are the same postings, moved once: matched sets are marked, not filtered out, and the filters
    that Spark derives for one side hold for the other.
    """
    index = index.where(" AND ".join(f"{c} IS NOT NULL" for c in index.columns))
    left, right = (index.select("word", *[F.col(c).alias(c + side) for c in ("set_id", "n", "sketch", "at", "order")]) for side in "ab")
    na, nb = F.col("na"), F.col("nb")
    rest = F.least(na - F.col("ata"), nb - F.col("atb"))  # enough at the first word that a matching pair shares
    searched = F.when(F.col("orderb") % 2 == 0, F.col("orderb")).otherwise(-1)
    # A posting's columns repeat from row to row, so the table's files are far smaller than a broadcast of it.
    pairs = left.join(right.hint("merge"), (left["word"] == right["word"]) & (F.col("ordera") < searched) & _enough(na, nb, rest)
                      & _may_match(na, F.col("sketcha"), nb, F.col("sketchb")))
    return pairs.select(F.col("set_ida").alias("a"), F.col("set_idb").alias("b"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Per row: ``_row, doc_id, n_lines, n_removed, removed`` (places of the lines that an earlier line matches)."""
    lines = line_sets(docs)
    rows = lines.groupBy("_row").agg(F.any_value("doc_id").alias("doc_id"), F.count("*").alias("n_lines"))
    rows = materialize(stream_starts(rows, "n_lines", ties=("_row",)), "line-rows")
    start = F.when(F.col("doc_id").cast("long").isNull(), F.col("start") + LAST).otherwise(F.col("start"))
    worded = lines.where("n > 0").join(rows.select("_row", start.alias("start")), "_row").select(
        "_row", "line", "set_id", (F.col("start") + F.col("line")).alias("place"))
    firsts = materialize(worded.groupBy("set_id").agg(F.min("place").alias("first"), F.count("*").alias("_lines")), "line-firsts")
    # Only sets that remove a line somewhere: met more than once, or matched by an earlier set.
    matched = matched_sets(docs, firsts).withColumn("matched", F.lit(True))
    removing = materialize(
        firsts.join(matched, "set_id", "left").where("_lines > 1 OR matched").select(
            "set_id", "first", F.coalesce("matched", F.lit(False)).alias("matched")), "line-removing")
    gone = (
        worded.join(removing, "set_id").where(F.col("matched") | (F.col("place") != F.col("first")))
        .groupBy("_row").agg(F.array_sort(F.collect_list("line")).alias("removed"))
    )
    return rows.join(gone, "_row", "left").select(
        "_row", "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without_repeats(text: Column, removed: Column) -> Column:
    """A text without the lines at the given places."""
    kept = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(removed, i))
    return F.array_join(kept, "\n")
