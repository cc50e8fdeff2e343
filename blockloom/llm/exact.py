"""Exact deduplication by recipes of content-defined chunks.

A normalised text is cut where its content says so: after a run of letter classes at least ``CHUNK_MIN`` characters
behind the previous cut, at the latest after ``CHUNK_MAX``. Equal texts are cut alike. A chunk's identifier is a pair of
64-bit hashes; all distinct chunk contents meet once, by identifier, and no identifier may stand for two contents, else
the identifiers are made anew with another salt. The recipe of a document is the list of its identifiers, and two texts
are equal if and only if their recipes are. Only the recipes are grouped and joined, never the texts.

Defined results: a null text counts as empty, and all empty texts are equal; of equal texts the row with the most code
points stays, then the smallest ``doc_id`` (null last), then one of the repeated rows; an empty table gives an empty
result. Other columns are not read, whatever their names; a very long text is chunked by one task and only its chunks move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import numbered, text_of
from blockloom.session import materialize

CHUNK_MIN = 200
CHUNK_MAX = 1500
CUT_AFTER = "[aeiouy][b-dlnprt][aeiouy][f-hj-np-tv-z]"
CHUNK = rf"(?s).{{{CHUNK_MIN},{CHUNK_MAX}}}?{CUT_AFTER}|.{{1,{CHUNK_MAX}}}"


def normalised() -> Column:
    """The text without space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.translate(text_of(), " \t\n\x0b\x0c\r", "")


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def identifier(chunk: Column, salt: int) -> Column:
    return F.array(F.xxhash64(chunk, F.lit(salt)), F.xxhash64(F.lit(~salt), chunk))


def recipes(docs: DataFrame, identify: Callable[[Column, int], Column] = identifier) -> DataFrame:
    """The written table ``_row, doc_id, n_points, text_sha256, recipe``, its identifiers verified."""
    salt = 0
    while True:
        made = docs.select("doc_id", F.length(text_of()).alias("n_points"), normalised().alias("_text"))
        made = made.select(
            "doc_id", "n_points", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"),
            F.flatten(F.transform(chunks(F.col("_text")), lambda c: identify(c, salt))).alias("recipe"),
        )
        made = materialize(numbered(made), "recipes")
        if ambiguous(docs, identify, salt).isEmpty():
            return made
        salt += 1


def ambiguous(docs: DataFrame, identify: Callable[[Column, int], Column], salt: int) -> DataFrame:
    """Identifiers that stand for more than one chunk content. Equal chunks are merged before they move."""
    contents = docs.select(F.explode(chunks(normalised())).alias("chunk")).distinct()
    named = contents.select(identify(F.col("chunk"), salt).alias("id"))
    return named.groupBy("id").count().where("count > 1")


def exact_groups(docs: DataFrame, identify: Callable[[Column, int], Column] = identifier) -> DataFrame:
    """Per row: ``_row, doc_id, keep_id, group_size, kept, text_sha256``."""
    made = recipes(docs, identify)
    best = F.min(F.struct(-F.col("n_points"), F.col("doc_id").isNull(), "doc_id", "_row"))
    # Written, so that the join below deals out both sides and a hot recipe can be split.
    groups = materialize(made.groupBy("recipe").agg(F.count("*").alias("group_size"), best.alias("best")), "recipe-groups")
    return made.join(groups, "recipe").select(
        "_row", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("_row") == F.col("best._row")).alias("kept"), "text_sha256",
    )
