"""Mixing sources to target weights.

The words of every source form one stream, packed into blocks of a fixed length. An output shard draws how many of
its slots each source fills, a multinomial draw by the sources' needs; then the draws are corrected so that each
source's counts over all shards add up to its need. Numbering a source's slots over all shards gives each an index; a pseudorandom permutation per source and pass maps the index
to a block, and the slots join the blocks by (source, block). A pass uses every block of its source once, so with a
limit of two passes no document is taken more than twice.

Defined results: a null text has no words, as an empty one; documents without words are taken 0 times; a null source
is a source of its own, last in order; repeated rows are documents of their own; an empty table gives an empty result.
Other columns, whatever their names, pass through the mixed documents; a very long text is cut by the task that holds its row. One row per
source meets in a window, so the number of sources is bounded by what one task sorts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import SPACE, numbered, stream_starts, text_of, word_count
from blockloom.operators.order import with_start
from blockloom.session import materialize

BLOCK_WORDS = 128
SHARD_SLOTS = 8192
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
SEED = 20240601
ROUNDS = 24
CELLS = 1024


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """The place of ``index`` in a pseudorandom permutation of ``0 .. n-1``: a swap-or-not shuffle.

    Every round pairs the indexes by a reflection and swaps a pair or not by one hash of the pair, so each round,
    and hence the whole, is a bijection for any ``n``.
    """
    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), *key, r), n) - x, n)
        swap = F.xxhash64(F.lit(SEED + 1), *key, r, F.greatest(x, partner)).bitwiseAND(1) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), index, step)


def targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT,
    block: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per source: ``source, s, source_size, blocks, weight, target``.

    Targets share ``share`` times all words by weight. A source stops at ``limit`` times its size and what it leaves
    is reshared. With sources in order of size per weight, the level per weight that results is the largest of
    ``(all - limits before) / (weights left)``. One row per source meets in a window.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1
    sums = sums.withColumn("s", rank).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("s", F.lit(len(weights))) + 1).cast("int"))
    )
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "s").rowsBetween(Window.unboundedPreceding, -1)
    room = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * limit
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    return (
        sums.withColumn("_level", room / left).withColumn("_level", F.max("_level").over(everything))
        .select(
            "source", "s", "source_size", F.ceil(F.col("source_size") / block).alias("blocks"), "weight",
            F.least(F.col("source_size") * float(limit), F.col("weight") * F.col("_level")).alias("target"),
        )
    )


def needs(sources: DataFrame) -> DataFrame:
    """``s, need, base``: the slots that each source fills in all, and those of the sources before it.

    Needs are rounded in running sums, so that all sources together fill the sum of their needs and thousands of needs
    under half a slot are not all rounded to none. One row per source meets in a window, as in ``targets``.
    """
    need = F.coalesce(F.try_divide(F.col("blocks") * F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    part = F.col("_need") - F.floor("_need")
    upto = F.floor(F.sum("_part").over(Window.orderBy("s")) + 0.5)
    return (
        sources.withColumn("_need", need).withColumn("_part", part).withColumn("_upto", upto)
        .withColumn("need", F.floor("_need") + F.col("_upto") - F.coalesce(F.lag("_upto").over(Window.orderBy("s")), F.lit(0)))
        .select("s", "need").withColumn("base", F.sum("need").over(Window.orderBy("s")) - F.col("need"))
    )


def _owned(rows: DataFrame, number: Column, shares: DataFrame, total: int, n_shares: int) -> DataFrame:
    """``rows`` with the ``s`` of ``shares``, ``s, share, base``, whose numbers from ``base`` on hold ``number``.

    The numbers below ``total`` fall into cells, at least four per share, and meet the shares that reach into their cell.
    """
    cells = max(CELLS, 4 * n_shares)
    width = -(-total // cells) or 1
    reach = F.sequence(F.floor(F.col("base") / width), F.floor((F.col("base") + F.col("share") - 1) / width))
    known = shares.where("share > 0").select("s", "share", "base", F.explode(reach).alias("_cell"))
    rows = rows.withColumn("_number", number).withColumn("_cell", F.floor(F.col("_number") / width))
    held = (F.col("_number") >= F.col("base")) & (F.col("_number") < F.col("base") + F.col("share"))
    return rows.join(known, "_cell").where(held).drop("_cell", "_number", "share", "base")


def _each(rows: DataFrame, n: str, name: str) -> DataFrame:
    """Every row repeated with ``name`` from 0 to ``n - 1``, dealt to tasks by number of results, not by bytes read."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.where(F.col(n) > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / CELLS))).alias("_high"))
    each = F.sequence(F.lit(0).cast("long"), F.least(F.lit(CELLS).cast("long"), F.col(n) - F.col("_high") * CELLS) - 1)
    return spread.repartition(tasks).select("*", F.explode(each).alias("_low")).withColumn(
        name, F.col("_high") * CELLS + F.col("_low")).drop("_high", "_low")


def shard_counts(sources: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``s, shard, count``: how many slots of each output shard a source fills.

    Every slot of a shard draws its source by its share of all needs, so a shard's counts are a multinomial draw. Over all
    shards a source then has some slots too many or too few. It gives up those too many, chosen by a permutation of its
    slots, and they go, in the order of another permutation, to the sources with too few.
    """
    spark = sources.sparkSession
    wanted = materialize(needs(sources), "mix-needs")
    row = wanted.agg(F.sum("need").alias("n"), F.count("*").alias("k")).first()
    total, n_sources = row["n"] or 0, row["k"]
    shards = max(1, round(total / shard_slots))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots_ = spark.range(0, total, 1, tasks).select(F.col("id").alias("_slot"), F.expr(f"id * {shards} div {max(1, total)}").alias("shard"))
    number = F.pmod(F.xxhash64(F.lit(SEED + 4), "_slot"), F.lit(max(1, total)).cast("long"))
    drawn = _owned(slots_, number, wanted.withColumnRenamed("need", "share"), total, n_sources)
    drawn = materialize(drawn.groupBy("s", "shard").agg(F.count("*").alias("count")), "mix-drawn")

    sums = materialize(wanted.join(drawn.groupBy("s").agg(F.sum("count").alias("_drawn")), "s", "left").select(
        "s", "need", F.coalesce("_drawn", F.lit(0)).alias("_drawn")), "mix-sums")
    over = with_start(drawn, "count", ("s",), "shard").join(sums.where("_drawn > need"), "s")
    given = _each(over, "count", "_i").where(
        permuted(F.col("start") + F.col("_i"), F.col("_drawn"), F.col("s"), F.lit(-1)) >= F.col("need"))
    given = materialize(given.groupBy("s", "shard").agg(F.count("*").alias("_given")), "mix-given")

    short = sums.where("_drawn < need").select("s", (F.col("need") - F.col("_drawn")).alias("share"))
    short = materialize(short.withColumn("base", F.sum("share").over(Window.orderBy("s")) - F.col("share")), "mix-short")
    open_ = with_start(given.groupBy("shard").agg(F.sum("_given").alias("_n")), "_n", (), "shard")
    n_open = given.agg(F.sum("_given").alias("n")).first()["n"] or 0
    seats = _each(open_, "_n", "_i").select("shard", (F.col("start") + F.col("_i")).alias("_seat"))
    place = permuted(F.col("_seat"), F.lit(max(1, n_open)).cast("long"), F.lit(-2))
    added = _owned(seats, place, short, n_open, n_sources).select("s", "shard", F.lit(1).cast("long").alias("count"))
    changes = given.select("s", "shard", (-F.col("_given")).alias("count")).unionByName(added)
    return drawn.unionByName(changes).groupBy("s", "shard").agg(F.sum("count").alias("count")).where("count > 0")


def slots(sources: DataFrame, limit: int = LIMIT, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``shard, place, s, pass, block``: the block that each slot of the mix takes. ``place`` orders a shard's slots."""
    counts = with_start(materialize(shard_counts(sources, shard_slots), "mix-counts"), "count", ("s",), "shard")
    return (
        _each(counts.join(sources.select("s", "blocks"), "s"), "count", "_i")
        .withColumn("_index", F.col("start") + F.col("_i"))
        .where(F.col("_index") < F.col("blocks") * limit)
        .withColumn("pass", F.floor(F.col("_index") / F.col("blocks")))
        .select(
            "shard", F.xxhash64(F.lit(SEED + 3), "shard", "s", "_index").alias("place"), "s", "pass",
            permuted(F.col("_index") - F.col("pass") * F.col("blocks"), F.col("blocks"), F.col("s"), F.col("pass")).alias("block"),
        )
    )


def pieces(placed_docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """``s, block, _row, first, words``: the words of each document that lie in each block."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    return (
        placed_docs.where("size > 0")
        .select("s", "_row", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), last)).alias("block"))
        .withColumn("first", F.greatest(F.col("start"), F.col("block") * block) - F.col("start"))
        .select("s", "block", "_row", "first", (
            F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start")) - F.col("first")).alias("words"))
    )


def mix(rows: DataFrame, sources: DataFrame, block: int = BLOCK_WORDS, limit: int = LIMIT, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``shard, place, s, pass, block, _row, first, words``: what the slots of the mix hold.

    ``rows`` has ``_row, doc_id, source, size, tie``; ``sources`` is the result of ``targets``.
    """
    rows = rows.join(sources.select("source", "s").withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    streams = stream_starts(rows.select("_row", "doc_id", "s", "size", "tie"), "size", ("s",), ("tie", "_row"))
    # Both sides grow with the corpus. Spark would take the slots, a few bytes of counts before they are spread, for small.
    return slots(sources, limit, shard_slots).hint("merge").join(pieces(streams, block), ["s", "block"])


def measured(docs: DataFrame, *columns: Column) -> DataFrame:
    """The written table of documents with ``_row``, ``size`` in words and ``tie``, an order among equal ids."""
    text = text_of()
    return materialize(numbered(docs.select(
        "doc_id", "source", *columns, word_count(text).alias("size"), F.xxhash64(text).alias("tie"))), "mix-rows")


def taken(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken``; no text moves."""
    rows = measured(docs)
    sources = materialize(targets(rows), "mix-sources")
    held = mix(rows, sources).groupBy("_row").agg(F.sum("words").alias("taken"))
    known = sources.select(F.col("source").alias("_source"), "source_size", "target")
    return (
        rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).join(held, "_row", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row per document and pass with the words taken, in order, with the spaces after them.

    A document that a pass takes whole keeps its text unchanged. Documents without words are passed on once.
    Other columns keep their values, ``n_chars`` follows the text.
    """
    rows = measured(docs, F.struct("*").alias("_doc"))
    sources = materialize(targets(rows), "mix-sources")
    held = (
        mix(rows.select("_row", "doc_id", "source", "size", "tie"), sources).groupBy("_row", "pass")
        .agg(F.sum("words").alias("_taken"), F.array_sort(F.collect_list(F.struct("first", "words"))).alias("_pieces"))
    )
    text = F.col("_doc.text")
    words = F.regexp_extract_all(text, F.lit(rf"(?:\A[{SPACE}]+)?[^{SPACE}]+[{SPACE}]*"), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("_pieces", lambda p: F.slice(
        F.col("_words"), (p["first"] + 1).cast("int"), p["words"].cast("int")))), "")
    whole = F.col("_taken") == F.col("size")
    mixed = (
        rows.where("size > 0").join(held, "_row")
        .withColumn("_words", F.when(~whole, words))
        .withColumn("_text", F.when(whole, text).otherwise(cut))
    )
    result = mixed.select("_doc", "_text").unionByName(rows.where("size = 0").select("_doc", text.alias("_text")))
    made = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return result.select(*[made.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns])
