"""Benchmark decontamination by q-gram counting in diagonal bands.

A passage within ``k`` edits of an item of length ``m`` keeps at least ``m - q + 1 - k * q`` of its q-grams, and their
diagonals (place in the text minus place in the item) lie within ``k`` of each other. Shared grams are counted per item
in bands of ``2 * (k + 1)`` diagonals that overlap by half, so some band holds them all. Bands that reach the bound are
verified by an alignment that fills only the band. Texts and items are compared in lower case with white space runs as
one space; places refer to the text as it is.

The items are the query set: they go to the tasks in blocks of at most ``BLOCK_CHARS`` characters, one index each, and
every document is searched against every block.

Defined results: a null text counts as empty and holds no passage; items without characters match nothing; items shorter
than ``q`` match only a whole text; repeated items and rows are reported each; null ids are kept; empty tables give an
empty result. Other columns, whatever their names, are kept by the filter and not read. A very long text is searched whole by
one task, in some sixteen bytes of memory per character and gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import text_of
from blockloom.session import materialize

Q = 8
EDIT_SHARE = 0.08
BLOCK_CHARS = 4_000_000
RUN_CHARS = 2_000_000
FILTER_BITS = 22
HITS = "array<struct<item_id:long,start:int,end:int,edits:int>>"

STEP = 0x9E3779B97F4A7C15
_lower: list[np.ndarray] = []


def _lower_case(codes: np.ndarray) -> np.ndarray:
    """Code points below 65,536 in lower case, where that is one code point."""
    if not _lower:
        each = (chr(c).lower() if not 0xD800 <= c < 0xE000 else "" for c in range(1 << 16))
        _lower.append(np.array([ord(x) if len(x) == 1 else c for c, x in enumerate(each)], np.uint32))
    return np.where(codes < 1 << 16, _lower[0][np.minimum(codes, 0xFFFF)], codes)


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised text, and the place of each in the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 0xA0) | (codes == 0x3000)
    kept = ~space
    kept[1:] |= space[1:] & ~space[:-1]
    if codes.size:
        kept[0] = not space[0]
    places = np.flatnonzero(kept)
    codes = np.where(space, np.uint32(32), codes)[places]
    if codes.size and codes[-1] == 32:
        codes, places = codes[:-1], places[:-1]
    return _lower_case(codes), places


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams, doubling the length in each pass."""
    h, width = codes.astype(np.uint64), 1
    while width < Q:
        h = h[:-width] * np.uint64(pow(STEP, width, 1 << 64)) + h[width:]
        width *= 2
    return h


class Items:
    """The q-gram index of a block of items."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        self.ids = ids
        self.codes = [normalise(t)[0] for t in texts]
        self.size = np.array([c.size for c in self.codes], np.int64)
        self.edits = np.minimum((EDIT_SHARE * self.size).astype(np.int64), np.maximum((self.size - Q) // Q, 0))
        self.need = self.size - Q + 1 - self.edits * Q
        long = np.flatnonzero(self.size >= Q)
        self.short: dict[bytes, list[int]] = {}
        for i in np.flatnonzero((self.size < Q) & (self.size > 0)):
            self.short.setdefault(self.codes[i].tobytes(), []).append(int(i))
        grams = [gram_hashes(self.codes[i]) for i in long]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(long, [g.size for g in grams]) if grams else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(g.size) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.item, self.place = item[order], place[order]
        self.gram, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._cell(self.gram)] = True

    @staticmethod
    def _cell(grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(STEP)) >> np.uint64(64 - FILTER_BITS)

    def candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and bands that share enough grams with a run of texts."""
        none = np.zeros(0, np.int64)
        if codes.size < Q or not self.gram.size:
            return none, none
        hashes = gram_hashes(codes)
        at = np.flatnonzero(self.filter[self._cell(hashes)])
        index = np.minimum(np.searchsorted(self.gram, hashes[at]), self.gram.size - 1)
        hit = self.gram[index] == hashes[at]
        at, index = at[hit], index[hit]
        count = self.count[index]
        posting = np.repeat(self.first[index] - np.cumsum(count) + count, count) + np.arange(count.sum())
        item = self.item[posting]
        width = self.edits[item] + 1
        band = (np.repeat(at, count) - self.place[posting]) // width
        keys = np.concatenate([(item << 40) + band + 1024, (item << 40) + band + 1023])
        keys, shared = np.unique(keys, return_counts=True)
        keys = keys[shared >= self.need[keys >> 40]]
        return keys >> 40, (keys & ((1 << 40) - 1)) - 1024

    def passages(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """``(text, item, start, end, edits)`` of all verified passages in texts that lie in ``codes``."""
        found = set()
        for item, band in zip(*self.candidates(codes)):
            pattern, k = self.codes[item], int(self.edits[item])
            low, high = int(band) * (k + 1), (int(band) + 2) * (k + 1) - 1
            first = int(np.searchsorted(ends, max(low, 0), side="right"))
            while first < starts.size and starts[first] <= high + pattern.size:
                text = codes[starts[first]:ends[first]]
                passage = align(pattern, text, low - int(starts[first]), high - int(starts[first]), k)
                if passage:
                    found.add((first, int(item), *passage))
                first += 1
        for i in np.flatnonzero((ends - starts < Q) & (ends > starts)) if self.short else ():
            for item in self.short.get(codes[starts[i]:ends[i]].tobytes(), ()):
                found.add((int(i), item, 0, int(ends[i] - starts[i]), 0))
        return sorted(found)


def _fill(pattern: np.ndarray, text: np.ndarray, low: int, width: int, start: np.ndarray) -> np.ndarray:
    """Edits of the pattern against text that ends on each diagonal ``low .. low + width - 1``."""
    big = np.int64(1 << 30)
    steps = np.arange(width)
    padded = np.full(pattern.size + width, np.uint32(0xFFFFFFFF))
    begin, end = max(low, 0), min(text.size, low + padded.size)
    if begin < end:
        padded[begin - low:end - low] = text[begin:end]
    row = start
    for i, code in enumerate(pattern):
        same = padded[i:i + width]
        inside = same != 0xFFFFFFFF
        step = np.where(inside, row + (same != code), big)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - steps) + steps
    return row


def align(pattern: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """``start, end, edits`` of the best passage whose diagonals lie in the band, if within ``k`` edits."""
    m = pattern.size
    for at in range(max(low, 0), min(high, text.size - m) + 1):
        if text[at] == pattern[0] and np.array_equal(text[at:at + m], pattern):
            return at, at + m, 0
    if not k:
        return None
    low, high = low - k, high + k
    width = high - low + 1
    free = np.where((np.arange(low, high + 1) >= 0) & (np.arange(low, high + 1) <= text.size), 0, 1 << 30)
    row = _fill(pattern, text, low, width, free)
    best = int(row.min())
    if best > k:
        return None
    end = min(max(int(np.argmin(row)) + low + m, 0), text.size)
    # The same band backwards from that end gives the start.
    back = _fill(pattern[::-1], text[:end][::-1], -k, 2 * k + 1, np.where(np.arange(-k, k + 1) == 0, 0, 1 << 30))
    length = m + int(np.argmin(back)) - k
    return max(end - length, 0), end, best


def leaks(text: Column, items: Items) -> Column:
    """The passages of the items in each text: ``array<struct<item_id, start, end, edits>>``."""
    @F.arrow_udf(HITS)
    def search(texts: pa.Array) -> pa.Array:
        rows: list[list[dict]] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            sizes = np.array([c.size for c, _ in held], np.int64)
            # A code point that no text has stands between two texts.
            apart = np.array([0xFFFFFFFE], np.uint32)
            codes = np.concatenate([x for c, _ in held for x in (c, apart)])
            ends = np.cumsum(sizes + 1) - 1
            hits: list[list[dict]] = [[] for _ in held]
            for i, item, start, end, edits in items.passages(codes, ends - sizes, ends):
                places = held[i][1]
                hits[i].append({"item_id": items.ids[item], "start": int(places[start]), "end": int(places[end - 1]) + 1, "edits": edits})
            rows.extend(hits)
            held.clear()

        total = 0
        for value in texts:
            held.append(normalise(value.as_py()))
            total += held[-1][0].size
            if total >= RUN_CHARS:
                flush()
                total = 0
        if held:
            flush()
        kind = pa.list_(pa.struct([("item_id", pa.int64()), *((n, pa.int32()) for n in ("start", "end", "edits"))]))
        return pa.array(rows, kind)

    return search(text)


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[list[int | None], list[str]]]:
    """The query set's ids and texts, in blocks of a bounded number of characters or of one longer item, one at a time."""
    ids: list[int | None] = []
    texts: list[str] = []
    total = 0
    for row in benchmark.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        if ids and total >= block_chars:
            yield ids, texts
            ids, texts, total = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        total += len(row["text"])
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, start, end, edits`` for every passage of an item in a document.

    Each block of items is a job of its own whose hits are written; the driver holds one block at a time.
    """
    def hits(items: Items) -> DataFrame:
        return docs.select("doc_id", F.explode(leaks(text_of(), items)).alias("h")).select("doc_id", "h.*")

    found = None
    for ids, texts in blocks(benchmark, block_chars):
        part = materialize(hits(Items(ids, texts)), "leaks")
        found = part if found is None else found.unionByName(part)
    return hits(Items([], [])) if found is None else found


def without_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no passage of any item, unchanged. Beyond the first block, what is left is written first."""
    for n, (ids, texts) in enumerate(blocks(benchmark, block_chars)):
        docs = materialize(docs, "leak-free") if n else docs
        docs = docs.where(F.size(leaks(text_of(), Items(ids, texts))) == 0)
    return docs
