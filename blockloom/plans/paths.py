"""Dotted paths into nested records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Value = tuple[Column, T.DataType]


def _position(segment: str) -> int | None:
    try:
        return int(segment)
    except ValueError:
        return None


def _item(array: Column, position: int) -> Column:
    """Element by position, negative from the end, null when out of range."""
    return F.get(array, F.lit(position) if position >= 0 else F.size(array) + F.lit(position))


def child(value: Column, dtype: T.DataType, segment: str) -> Value | None:
    """One step down; None when the schema rules the step out."""
    if isinstance(dtype, T.StructType):
        if segment not in dtype.names:
            return None
        return value.getField(segment), dtype[segment].dataType
    if isinstance(dtype, T.MapType):
        return F.try_element_at(value, F.lit(segment)), dtype.valueType
    if isinstance(dtype, T.ArrayType):
        position = _position(segment)
        return None if position is None else (_item(value, position), dtype.elementType)
    if isinstance(dtype, T.VariantType):
        # JSON paths know no escapes, so the quote is one the name does not contain.
        quote = "'" if "'" not in segment else '"'
        if quote in segment:
            found = F.try_element_at(F.try_variant_get(value, "$", "map<string, variant>"), F.lit(segment))
        else:
            found = F.try_variant_get(value, f"$[{quote}{segment}{quote}]", "variant")
        position = _position(segment)
        if position is not None:
            found = F.coalesce(found, _item(F.try_variant_get(value, "$", "array<variant>"), position))
        return F.when(~F.is_variant_null(found), found), dtype
    return None


def resolve(schema: T.StructType, path: str, root: str | None = None) -> Value | None:
    """Column and type of a dotted path; a null on the way gives null.

    ``root`` names a VARIANT column that holds whole records, as JSON sources deliver them.
    """
    segments = path.split(".")
    if root is not None:
        found: Value | None = (F.col(root), schema[root].dataType)
    elif segments[0] in schema.names:
        first = segments.pop(0)
        found = (F.col(f"`{first}`"), schema[first].dataType)
    else:
        return None
    for segment in segments:
        found = child(*found, segment)
        if found is None:
            return None
    return found
