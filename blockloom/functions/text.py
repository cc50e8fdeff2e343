"""Text helpers as built-in Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.fixed import WHITESPACE

INTEGRAL_KINDS = ("TINYINT", "SMALLINT", "INT", "BIGINT")
NUMERIC_KINDS = (*INTEGRAL_KINDS, "FLOAT", "DOUBLE")


def strip(text: Column) -> Column:
    """Remove outer Unicode whitespace; built-in ``trim`` alone would only remove U+0020."""
    return F.btrim(text, F.lit(WHITESPACE))


def nonblank(text: Column) -> Column:
    """The stripped text, or null when nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def capitalize(word: Column) -> Column:
    """First letter upper, the rest lower; ``initcap`` would do so for every word."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))


def variant_kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def variant_is_number(value: Column) -> Column:
    kind = variant_kind(value)
    return kind.isin(*NUMERIC_KINDS) | kind.startswith("DECIMAL")


def variant_items(value: Column) -> Column:
    """The elements of a JSON array, null for any other JSON value."""
    return F.when(
        variant_kind(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")
    )


def as_text(value: Column, dtype: T.DataType) -> Column:
    """The text form of any value; nested values become JSON."""
    if isinstance(dtype, T.StringType):
        return value
    if isinstance(dtype, T.BooleanType):
        return F.initcap(value.cast("string"))
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(value)
    if isinstance(dtype, T.VariantType):
        plain = F.try_variant_get(value, "$", "string")
        return F.when(variant_kind(value) == "BOOLEAN", F.initcap(plain)).otherwise(plain)
    return value.cast("string")


def truthy(value: Column, dtype: T.DataType) -> Column:
    """False for null, empty text, zero, false and empty collections; never null."""
    if isinstance(dtype, T.StringType):
        test = value != ""
    elif isinstance(dtype, T.BooleanType):
        test = value
    elif isinstance(dtype, T.NumericType):
        test = value != 0
    elif isinstance(dtype, (T.ArrayType, T.MapType)):
        test = F.size(value) > 0
    elif isinstance(dtype, T.VariantType):
        kind = variant_kind(value)
        plain = F.try_variant_get(value, "$", "string")
        test = (
            F.when(kind == "STRING", plain != "")
            .when(kind == "BOOLEAN", plain == "true")
            .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~plain.isin("[]", "{}"))
            .when(variant_is_number(value), F.try_variant_get(value, "$", "double") != 0)
            .otherwise(kind != "VOID")
        )
    else:
        test = value.isNotNull()
    return F.coalesce(test, F.lit(False))


def join_items(items: Column, element: T.DataType) -> Column:
    """Text of a list value: its truthy elements, one per line."""
    kept = F.filter(items, lambda item: truthy(item, element))
    return F.array_join(F.transform(kept, lambda item: as_text(item, element)), "\n")


def all_of(conditions: list[Column]) -> Column:
    """Conjunction; true for no conditions."""
    return reduce(lambda left, right: left & right, conditions) if conditions else F.lit(True)


def id_digest(ids: Column) -> Column:
    """md5 of the ids as decimal text, a scalar that other engines can reproduce."""
    return F.md5(F.array_join(ids.cast("array<string>"), " ").cast("binary"))
