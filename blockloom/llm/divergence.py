"""How the sources of a language differ in their words: distances of all pairs, and the terms each source overuses.

A term is a run of letters, lower case in A-Z. Each language keeps the terms of at least ``LEAST_DOCS`` of its documents.
A group, the documents of one source in one language, and the language itself give each kept term a smoothed share in
billionths, ``1 + floor(10^9 (count + 5) / (N + 5 V))``, in decimal arithmetic.

* The distance of two groups is the sum of the differences of their shares. Shares of terms that a group does not have
  are all alike, so only occurring terms are compared: terms are dealt into buckets, sources into blocks, and a task
  compares two blocks of sources over one bucket of terms.
* The terms that a group overuses most come from dominance skybands. A term is dominated by one of at least its count
  in the group and at most its count in the language that comes earlier in UTF-8: that one always ranks before it. So a
  term that ``TOP`` others dominate is none of the first ``TOP``. Partitions of a group's terms keep the terms that
  fewer dominate, the skybands of several partitions are merged and reduced again, and what is left is ranked exactly.

Defined results: null texts, languages and sources are empty strings; rows of one or no ``doc_id`` are documents of
their own; other columns are not read, whatever their names; a group without kept terms has distances, and no terms; an
empty table gives no rows. Long texts are read in windows between terms; a task holds ``SLICE_BYTES`` of text or one
longer term, and the distinct terms of a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import text_of
from blockloom.llm.encoding import SLICE_BYTES, buffers, text_slices
from blockloom.session import materialize

LEAST_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP = 50
#: Sources per block and terms per bucket of a task that compares; terms per partition of a skyband.
BLOCK_SOURCES, BUCKET_TERMS, PART_TERMS = 256, 2048, 2048
#: Skybands that are merged at once.
MERGED = 16

TERM = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of texts that lie in ``data`` with a line end behind each, and the text of each term."""
    inside = np.concatenate([[False], TERM[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    terms = pa.Array.from_buffers(pa.string(), starts.size, [
        None, pa.py_buffer(bounds), pa.py_buffer(LOWER[data[inside[1:-1]]])])
    return terms.dictionary_encode(), np.searchsorted(offsets, starts, "right") - 1


def _long(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct terms of one text and their counts, window by window."""
    data, at, parts = buffers(text)[0], 0, []
    while at < data.size:
        end, reach = data.size, SLICE_BYTES
        while at + reach < data.size and end == data.size:
            gaps = np.flatnonzero(~TERM[data[at + 1:at + reach]])
            end, reach = at + 1 + int(gaps[-1]) if gaps.size else end, reach * 4
        coded, _ = _terms(data[at:end], np.zeros(1, np.int64))
        counts = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
        parts.append(pa.table({"term": coded.dictionary, "count": counts}))
        if len(parts) > 8:
            parts = [_added(parts)]
        at = end
    found = _added(parts)
    return found["term"].combine_chunks(), found["count"].to_numpy()


def _added(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("term").aggregate([("count", "sum")]).rename_columns({"count_sum": "count"})


def term_counts(docs: DataFrame) -> DataFrame:
    """The written table ``lang, source, term, count, docs``; each group has a row with a null term."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
            names, number = np.unique(np.array([f"{a}\0{len(a)}\0{b}" for a, b in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist())], object), return_inverse=True)
            some = np.empty(names.size, np.int64)
            some[number] = np.arange(number.size)
            groups, done = groups.take(pa.array(some)), 0
            for part in text_slices(batch.column(2)):
                group = number[done:done + len(part)]
                done += len(part)
                if len(part) == 1 and pc.binary_length(part)[0].as_py() > 2 * SLICE_BYTES:
                    terms, counts = _long(part)
                    yield _rows(groups, np.full(len(terms), group[0]), terms, counts, np.ones(len(terms), np.int64))
                    continue
                data, offsets = buffers(pc.binary_join_element_wise(part, "", "\n"))
                coded, owner = _terms(data, offsets)
                size = max(1, len(coded.dictionary))
                in_docs, counts = np.unique(owner * size + coded.indices.to_numpy(), return_counts=True)
                keys = group[in_docs // size] * size + in_docs % size
                order = np.argsort(keys, kind="stable")
                keys, counts = keys[order], counts[order]
                first = np.flatnonzero(np.diff(keys, prepend=-1))
                total = np.add.reduceat(counts, first) if first.size else counts
                n_docs = np.diff(np.append(first, keys.size))
                yield _rows(groups, keys[first] // size, coded.dictionary.take(pa.array(keys[first] % size)), total, n_docs)
            none = np.zeros(names.size, np.int64)
            yield _rows(groups, np.arange(names.size), pa.nulls(names.size, pa.string()), none, none)

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], text_of().alias("text"))
    found = rows.mapInArrow(each, "lang string, source string, term string, count long, docs long")
    return materialize(found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "term-counts")


def _rows(groups: pa.StructArray, group: np.ndarray, terms: pa.Array, counts: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    held = groups.take(pa.array(group))
    return pa.RecordBatch.from_arrays(
        [*held.flatten(), terms, pa.array(counts, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "count", "docs"])


def share(count: str, total: str, terms: str) -> Column:
    """A smoothed share in billionths, exact: products may pass 64 bits."""
    return F.expr(
        f"1 + CAST({SCALE} * CAST({count} + {SMOOTHING} AS DECIMAL(20, 0)) div "
        f"(CAST({total} AS DECIMAL(20, 0)) + {SMOOTHING} * CAST({terms} AS DECIMAL(17, 0))) AS LONG)")


def shares(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """The written tables of groups, ``lang, source, v, p0, n_terms``, and their terms, ``lang, source, term, count, lang_count, p, q``."""
    counts = term_counts(docs)
    kept = materialize(counts.where("term IS NOT NULL").groupBy("lang", "term").agg(
        F.sum("count").alias("lang_count"), F.sum("docs").alias("_docs")).where(F.col("_docs") >= least_docs).drop("_docs"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_count").alias("lang_n"))
    terms = materialize(counts.where("term IS NOT NULL").join(kept, ["lang", "term"]), "group-terms")
    sums = terms.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("n_terms"))
    groups = (
        counts.where("term IS NULL").select("lang", "source").join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
        .fillna(0, ["v", "lang_n", "n", "n_terms"]).withColumn("_none", F.lit(0).cast("long"))
        .withColumn("p0", F.when(F.col("v") > 0, share("_none", "n", "v")).otherwise(0)).drop("_none")
    )
    groups = materialize(groups, "term-groups")
    found = terms.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "count", "lang_count", share("count", "n", "v").alias("p"), share("lang_count", "lang_n", "v").alias("q"))
    return groups, materialize(found, "term-shares")


def distances(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """``lang, source, item, value``: for each two groups of a language the summed difference of their shares."""
    per_lang = groups.groupBy("lang").agg(
        F.ceil(F.count("*") / BLOCK_SOURCES).alias("_blocks"), F.ceil(F.greatest(F.max("v"), F.lit(1)) / BUCKET_TERMS).alias("_buckets"))
    each = groups.join(per_lang, "lang").withColumn("_block", F.pmod(F.xxhash64("source"), F.col("_blocks")))
    every = each.select("lang", "source", "_block", "_blocks", "p0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_buckets") - 1)).alias("bucket"))
    every = every.select("*", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"))
    held = terms.join(each.select("lang", "source", "_block", "_blocks", "_buckets", "p0"), ["lang", "source"]).select(
        "lang", "source", "_block", "_blocks", "p0", F.pmod(F.xxhash64("term"), F.col("_buckets")).alias("bucket"), "term", "p")
    # A block of sources meets every block, itself included, once per bucket.
    rows = every.unionByName(held).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    rows = rows.withColumns({"low": F.least("_block", "_other"), "high": F.greatest("_block", "_other")})

    def compare(table: pa.Table) -> pa.Table:
        sources = table["source"].combine_chunks().dictionary_encode()
        n = len(sources.dictionary)
        number, block, base = sources.indices.to_numpy(), np.zeros(n, np.int64), np.zeros(n, np.int64)
        block[number], base[number] = table["_block"].to_numpy(), table["p0"].to_numpy()
        held = table["term"].is_valid().to_numpy()
        names = table["term"].combine_chunks().dictionary_encode()
        matrix = np.repeat(base[:, None], len(names.dictionary), axis=1)
        at = np.flatnonzero(held)
        matrix[number[at], names.indices.to_numpy(zero_copy_only=False)[at].astype(np.int64)] = table["p"].combine_chunks().to_numpy(zero_copy_only=False)[at].astype(np.int64)
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        left, right, value = [], [], []
        for a in range(n):
            others = np.flatnonzero((block == (high if block[a] == low else low)) & (np.arange(n) != a))
            left.append(np.full(others.size, a))
            right.append(others)
            value.append(np.abs(matrix[others] - matrix[a]).sum(axis=1))
        left, right = np.concatenate(left), np.concatenate(right)
        return pa.table({
            "lang": table["lang"].take(pa.array(np.zeros(left.size, np.int64))), "source": sources.dictionary.take(pa.array(left)),
            "item": sources.dictionary.take(pa.array(right)), "value": pa.array(np.concatenate(value).astype(np.int64)),
            "n": pa.array(np.full(left.size, matrix.shape[1], np.int64)), "rest": pa.array(np.abs(base[left] - base[right]))})

    found = rows.groupBy("lang", "bucket", "low", "high").applyInArrow(
        compare, "lang string, source string, item string, value long, n long, rest long")
    sums = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("n").alias("n"), F.max("rest").alias("rest"))
    return sums.join(groups.select("lang", "source", "v"), ["lang", "source"]).select(
        "lang", "source", "item", (F.col("value") + (F.col("v") - F.col("n")) * F.col("rest")).alias("value"))


def skyband(terms: list[str], counts: np.ndarray, lang_counts: np.ndarray, k: int) -> np.ndarray:
    """The places of the terms that fewer than ``k`` others dominate.

    Dominating terms come first in the order taken here. Of the terms that dominate one, the first ``k`` in that order
    are in the skyband themselves, so only the terms kept so far are compared.
    """
    rank = np.empty(len(terms), np.int64)
    rank[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
    kept, kept_lang, kept_rank = [], np.empty(len(terms), np.int64), np.empty(len(terms), np.int64)
    for i in np.lexsort((rank, lang_counts, -counts)).tolist():
        n = len(kept)
        if n < k or ((kept_lang[:n] <= lang_counts[i]) & (kept_rank[:n] < rank[i])).sum() < k:
            kept_lang[n], kept_rank[n] = lang_counts[i], rank[i]
            kept.append(i)
    return np.array(kept, np.int64)


def overused(groups: DataFrame, terms: DataFrame, top: int = TOP) -> DataFrame:
    """``lang, source, item, value, rank``: the terms whose share in a group is most above that in its language."""
    def keep(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        return table.take(pa.array(skyband(
            table["term"].to_pylist(), table["count"].to_numpy(), table["lang_count"].to_numpy(), top)))

    parts = groups.select("lang", "source", F.ceil(F.greatest("n_terms", F.lit(1)) / PART_TERMS).alias("_parts"))
    n_parts = parts.agg(F.max("_parts").alias("n")).first()["n"] or 1
    band = terms.where("p > q").select("lang", "source", "term", "count", "lang_count", (F.col("p") - F.col("q")).alias("value"))
    band = band.join(parts, ["lang", "source"]).withColumn("part", F.pmod(F.xxhash64("term"), F.col("_parts"))).drop("_parts")
    while True:
        band = band.groupBy("lang", "source", "part").applyInArrow(keep, band.schema)
        if n_parts <= 1:
            break
        n_parts = -(-n_parts // MERGED)
        band = band.withColumn("part", F.expr(f"part div {MERGED}"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term"))
    return band.select("lang", "source", F.col("term").alias("item"), "value", rank.alias("rank")).where(F.col("rank") <= top)


def divergence(docs: DataFrame, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances of each group to the others, and the terms it overuses."""
    groups, terms = shares(docs)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = distances(groups, terms).withColumn("rank", F.row_number().over(order))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*names).unionByName(
        overused(groups, terms, top).withColumn("part", F.lit("term")).select(*names))
