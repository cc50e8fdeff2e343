"""Phrases of two to four words by Toivonen's sampled mining, scored by how firmly their parts belong together.

Texts fall into pieces at signs and line ends, pieces into words; all counts are per language. One pass counts all words
exactly. Then a sample of the documents proposes phrases: length by length, those that reach ``SAMPLE_MIN`` there and
whose two shorter ends are proposed. A full pass counts the proposals together with their negative border, the phrases
that are not proposed although both their ends are. Every phrase that is frequent and not among them has a frequent end
that was not proposed: a border phrase that turns out frequent. Such failures join the proposals, and another full pass
counts what they add to the border, until a pass shows no failure. Then all frequent phrases are known, whatever the
sample proposed.

A full pass runs twice over the texts. First it counts cells, 40 bits of a phrase's hash, as sorted 32-bit numbers with
a count byte each (counts above 255 stay 255). Then it counts, by the hashes of their words, the phrases of cells that
reach the minimum, and drops those that do not reach it themselves. Both counts are summed in a task first and leave it
as arrays, one per bucket of cells. Proposals and cells travel as bitmaps of a fixed size
(``bitmaps.BITS``); full bitmaps let more phrases through to the exact counts and change no result. The hashes of words are
checked: if two words of a language share one, all is done again with other hashes.

Defined results: a null text counts as empty and a null language as ``und``; rows of one or no ``doc_id`` are documents
of their own; other columns are not read, whatever their names; an empty table gives no phrases. Long texts are read in
windows that overlap by three words; a task holds ``SLICE_BYTES`` of text, or one longer word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm import bitmaps
from blockloom.llm.common import text_of
from blockloom.llm.encoding import SLICE_BYTES, buffers, text_slices
from blockloom.session import materialize

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
COVERED = (4, 5)
#: One document in ``SAMPLE_OF`` proposes; a phrase at the minimum occurs there 7.5 times on average.
SAMPLE_OF, SAMPLE_MIN = 4, 3
#: Words per bucket of cells.
BUCKET_WORDS = 1 << 19
#: Phrases that a task holds before it sends them, each with its sum so far.
HELD_PHRASES = 1 << 19
UND = "und"

BREAKS = np.isin(np.arange(256), [ord(c) for c in ".,;:!?\n\x0b\x0c\r"])
INSIDE = ~(BREAKS | np.isin(np.arange(256), [32, 9]))
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UND)).alias("lang"), text_of().alias("text"))


def _windows(texts: pa.Array) -> Iterator[tuple[np.ndarray, int]]:
    """Bytes of texts with line ends between them, and how many of the bytes are read here, the rest only looked at."""
    for part in text_slices(texts):
        if len(part) > 1 or (pc.binary_length(part)[0].as_py() <= 2 * SLICE_BYTES):
            data, _ = buffers(pc.binary_join_element_wise(part, "", "\n"))
            yield data, data.size
            continue
        data, at = buffers(part)[0], 0
        while at < data.size:
            # Own words start before ``end``, which is where a word ends; then come three more words, if there are any.
            end, reach = data.size, SLICE_BYTES
            while at + reach < data.size and end == data.size:
                gaps = np.flatnonzero(~INSIDE[data[at + 1:at + reach]])
                end, reach = at + 1 + int(gaps[-1]) if gaps.size else end, reach * 4
            stop, reach = end, 256
            while stop == end < data.size:
                inside = INSIDE[data[end:end + reach]]
                starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
                if starts.size >= LONGEST:
                    stop = end + int(starts[LONGEST - 1])
                elif end + reach >= data.size:
                    stop = data.size
                reach *= 4
            yield data[at:stop], end - at
            at = end


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray, int]]:
    """Per window: language, distinct words, the number of each word, whether the next one is in its piece, own words."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        for number, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column(1).filter(pc.equal(langs.indices, number))
            for data, own in _windows(texts):
                inside = np.concatenate([[False], INSIDE[data], [False]])
                edges = np.flatnonzero(inside[1:] != inside[:-1])
                starts, ends = edges[::2], edges[1::2]
                if not starts.size:
                    continue
                broken = np.cumsum(BREAKS[data])[starts]
                offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
                words = pa.Array.from_buffers(pa.binary(), starts.size, [
                    None, pa.py_buffer(offsets), pa.py_buffer(LOWER[data[inside[1:-1]]])])
                words = words.dictionary_encode()
                names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
                joined = np.append(broken[1:] == broken[:-1], False)
                yield lang, names, words.indices.to_numpy().astype(np.int64), joined, int(np.searchsorted(starts, own))


def word_counts(texts: DataFrame) -> DataFrame:
    """The written table ``lang, word, count`` of all words."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, names, numbers, _, own in _scan(batches):
            found = np.bincount(numbers[:own], minlength=len(names))
            seen = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * seen.size, pa.string()), pa.array(names, pa.binary()).cast(pa.string()).take(pa.array(seen)),
                pa.array(found[seen])], ["lang", "word", "count"])

    rows = texts.mapInArrow(each, "lang string, word string, count long")
    return materialize(rows.groupBy("lang", "word").agg(F.sum("count").alias("count")), "phrase-words")


# Hashes and cells.

def word_hash(word: Column, salt: str) -> Column:
    """The hash that ``_hashes`` gives."""
    return F.xxhash64(F.concat(F.lit(salt), word))


def _hashes(names: list[bytes], salt: str) -> np.ndarray:
    start = salt.encode()
    return np.fromiter((xxhash.xxh64_intdigest(start + w, 42) for w in names), np.uint64, len(names))


def _longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of the phrase without its last word and of that word."""
    x = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _first(lang: str, words: np.ndarray) -> np.ndarray:
    return _longer(np.full(words.size, xxhash.xxh64_intdigest(lang.encode(), 1), np.uint64), words)


def proposed(phrases: DataFrame) -> np.ndarray:
    """The bitmap of phrases, given as ``lang, words`` (arrays of word hashes)."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = bitmaps.empty()
        for batch in batches:
            bitmaps.put(bitmap, bitmaps.cells(_phrase_hashes(batch)))
        yield bitmaps.held(bitmap)

    return bitmaps.merged(phrases.select("lang", "words").mapInArrow(each, bitmaps.SCHEMA))


def _phrase_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """Hashes of the phrases of a batch of ``lang, words``."""
    sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
    words = batch.column(1).flatten().to_numpy().view(np.uint64)
    at = np.cumsum(sizes) - sizes
    langs = batch.column(0).dictionary_encode()
    starts = np.array([xxhash.xxh64_intdigest(x.encode(), 1) for x in langs.dictionary.to_pylist()], np.uint64)
    result = starts[langs.indices.to_numpy()]
    for i in range(LONGEST):
        held = np.flatnonzero(sizes > i)
        result[held] = _longer(result[held], words[at[held] + i])
    return result


# Counting.

def _phrases(
    batches: Iterator[pa.RecordBatch], salt: str, lengths: tuple[int, ...], new: np.ndarray, old: np.ndarray | None,
) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Per window and length: language, ``(phrases, words)`` hashes, the phrases' hashes and their counts.

    These are the phrases whose two shorter ends are in ``new``, without those whose ends are both in ``old``.
    """
    for lang, names, numbers, joined, own in _scan(batches):
        words = _hashes(names, salt)
        hashes = _first(lang, words)
        known, rank = [bitmaps.has(b, bitmaps.cells(hashes)) if b is not None else None for b in (new, old)], numbers
        for n in range(2, max(lengths) + 1):
            # ``rank`` numbers the phrases of n - 1 words by their start, -1 where there is none.
            fits = (rank >= 0) & known[0][rank]
            at = np.flatnonzero(fits[:-1] & fits[1:] & (joined[:-1] if n == 2 else True))
            if not at.size:
                break
            codes, keys = pd.factorize(rank[at] * len(names) + numbers[at + n - 1])
            some = np.empty(keys.size, np.int64)
            some[codes] = at
            head, tail = rank[some], rank[some + 1]
            longer = _longer(hashes[head], words[numbers[some + n - 1]])
            if n in lengths:
                found = np.bincount(codes[:np.searchsorted(at, own)], minlength=keys.size)
                held = found > 0
                if old is not None:
                    held &= ~(known[1][head] & known[1][tail])
                yield lang, words[numbers[some[held][:, None] + np.arange(n)]], longer[held], found[held]
            if old is not None:
                # A bitmap admits others too: earlier passes only reached phrases whose ends they had reached themselves.
                reached = known[1][head] & known[1][tail]
            hashes = longer
            known = [bitmaps.has(b, bitmaps.cells(hashes)) if b is not None else None for b in (new, old)]
            if old is not None:
                known[1] &= reached
            rank = np.full(numbers.size, -1)
            rank[at] = codes


def frequent_cells(
    texts: DataFrame, salt: str, lengths: tuple[int, ...], least: int, buckets: int, new: Broadcast, old: Broadcast | None = None,
) -> np.ndarray:
    """The bitmap of cells whose phrases are counted ``least`` times or more, at most 255."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, counts = [], []
        for _, _, hashes, found in _phrases(batches, salt, lengths, new.value, old and old.value):
            if hashes.size:
                cells.append(bitmaps.cells(hashes))
                counts.append(found)
            if sum(c.size for c in cells) >= bitmaps.HELD_CELLS:
                yield bitmaps.packed_cells(cells, counts, buckets)
                cells, counts = [], []
        if cells:
            yield bitmaps.packed_cells(cells, counts, buckets)

    return bitmaps.frequent(texts.mapInArrow(each, bitmaps.CELL_ROWS), least, buckets)


def phrase_counts(
    texts: DataFrame, salt: str, cells: Broadcast, buckets: int, new: Broadcast, old: Broadcast | None, least: int,
) -> DataFrame:
    """The written table ``lang, words, count, known`` of phrases counted ``least`` times; ``known`` if proposed."""
    lengths = tuple(range(2, LONGEST + 1))

    def sent(lang: str, n: int, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        bucket, words, counts = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((*words.T[::-1], bucket))
        bucket, words, counts = bucket[order], words[order], counts[order]
        new_one = np.append(True, (bucket[1:] != bucket[:-1]) | (words[1:] != words[:-1]).any(axis=1))
        first = np.flatnonzero(new_one)
        counts, words, bucket = np.add.reduceat(counts, first), words[first], bucket[first]
        cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), bucket.size)
        return pa.RecordBatch.from_arrays([
            pa.array([lang] * (cut.size - 1), pa.string()), pa.array(np.full(cut.size - 1, n, np.int32)), pa.array(bucket[cut[:-1]]),
            pa.array([words[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
            pa.array([counts[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["lang", "n", "bucket", "words", "counts"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        size = 0
        for lang, words, hashes, found in _phrases(batches, salt, lengths, new.value, old and old.value):
            own = bitmaps.cells(hashes)
            at = np.flatnonzero(bitmaps.has(cells.value, own))
            if at.size:
                held.setdefault((lang, words.shape[1]), []).append(
                    ((own[at] % np.uint64(buckets)).astype(np.int64), words[at], found[at]))
                size += at.size
            if size >= HELD_PHRASES:
                yield from (sent(*key, parts) for key, parts in held.items())
                held, size = {}, 0
        yield from (sent(*key, parts) for key, parts in held.items())

    def summed(table: pa.Table) -> pa.Table:
        lang, n = table["lang"][0].as_py(), table["n"][0].as_py()
        words = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["words"]]).reshape(-1, n)
        counts = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["counts"]])
        order = np.lexsort(words.T[::-1])
        words, counts = words[order], counts[order]
        first = np.flatnonzero(np.append(True, (words[1:] != words[:-1]).any(axis=1)))
        counts, words = np.add.reduceat(counts, first), words[first]
        words, counts = words[counts >= least], counts[counts >= least]
        hashes = _first(lang, words[:, 0])
        for i in range(1, n):
            hashes = _longer(hashes, words[:, i])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(counts.size + 1) * n, pa.int32()), pa.array(words.ravel().view(np.int64)))
        return pa.table({
            "lang": pa.array([lang] * counts.size, pa.string()), "words": lists, "count": counts,
            "known": bitmaps.has(new.value, bitmaps.cells(hashes))})

    rows = texts.mapInArrow(each, "lang string, n int, bucket long, words binary, counts binary")
    return materialize(rows.groupBy("lang", "n", "bucket").applyInArrow(
        summed, "lang string, words array<long>, count long, known boolean"), "phrase-counts")


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, sample_of: int = SAMPLE_OF, sample_min: int = SAMPLE_MIN) -> tuple[DataFrame, DataFrame]:
    """``lang, words, count`` of all phrases of up to four words with that count, and ``lang, word, hash, count`` of all words.

    ``words`` are word hashes, in order; phrases of one word are among them.
    """
    if not 1 <= min_count <= 255:
        raise ValueError("the minimum count is between 1 and 255")
    spark, texts = docs.sparkSession, _texts(docs)
    counts = word_counts(texts)
    for salt in map(str, count()):
        words = counts.withColumn("hash", word_hash(F.col("word"), salt))
        if words.groupBy("lang", "hash").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
    send = spark.sparkContext.broadcast
    total = counts.agg(F.sum("count").alias("n")).first()["n"] or 0
    buckets = max(bitmaps.BUCKETS, total // BUCKET_WORDS)
    found = words.where(F.col("count") >= min_count).select("lang", F.array("hash").alias("words"), "count")

    new = proposed(found)
    chosen = _texts(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(sample_of)) == 0))
    for n in range(2, LONGEST + 1):
        new = new | frequent_cells(chosen, salt, (n,), sample_min, buckets, send(new))

    old = None
    while True:
        sent = send(new)
        cells = frequent_cells(texts, salt, tuple(range(2, LONGEST + 1)), min_count, buckets, sent, old)
        counted = phrase_counts(texts, salt, send(cells), buckets, sent, old, min_count)
        found = found.unionByName(counted.drop("known"))
        failed = counted.where((F.size("words") < LONGEST) & ~F.col("known"))
        if failed.isEmpty():
            return found, words
        old, new = sent, new | proposed(failed)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """Per language the ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``."""
    found, words = frequent_phrases(docs, min_count)
    found = materialize(found, "phrases")
    phrases = found.where(F.size("words") > 1)

    # The cut with the lowest score, ties to the first.
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    first = found.select("lang", F.col("words").alias("_first"), F.col("count").alias("l"))
    rest = found.select("lang", F.col("words").alias("_rest"), F.col("count").alias("r"))
    cuts = (
        cuts.withColumn("_first", F.slice("words", F.lit(1), F.col("k")))
        .withColumn("_rest", F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")))
        .join(first, ["lang", "_first"]).join(rest, ["lang", "_rest"])
    )
    score = F.expr("CAST(2000000 * CAST(count AS DECIMAL(20, 0)) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0))) AS LONG)")
    best = cuts.withColumn("score", score).groupBy("lang", "words", "count").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # The most frequent longer phrase that holds a phrase.
    size = F.size("words")
    parts = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(
        F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("words", i, m))))
    holders = phrases.where(size > 2).select("lang", "count", F.explode(parts).alias("words")).groupBy("lang", "words").agg(
        F.max("count").alias("_holder"))
    over, under = COVERED
    kept = best.join(holders, ["lang", "words"], "left").where(
        F.col("_holder").isNull() | (F.col("_holder") * under < F.col("count") * over))

    # All that may be among the first by score and count; the phrase itself decides between the last of them.
    order = [F.col("score").desc(), F.col("a").desc()]
    kept = kept.select("lang", "words", F.col("count").alias("a"), "cut.l", "cut.r", "cut.score")
    kept = kept.withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_rank") <= top).drop("_rank")
    named = (
        kept.select("*", F.posexplode("words").alias("_at", "hash"))
        .join(words.where(F.col("count") >= min_count).select("lang", "hash", "word"), ["lang", "hash"])
        .groupBy("lang", "words", "a", "l", "r", "score").agg(F.array_sort(F.collect_list(F.struct("_at", "word"))).alias("_named"))
        .withColumn("phrase", F.array_join(F.col("_named.word"), " "))
    )
    totals = words.groupBy("lang").agg(F.sum("count").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    return (
        named.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
