"""Record filters: ``{"field": …, "op": …, "value": …}`` compiled against the column type.

A filter never casts: values of different kinds are unequal and cannot be ordered, a null drops the record.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.functions.text import INTEGRAL_KINDS, as_text, variant_is_number, variant_kind
from blockloom.plans.paths import resolve

ORDERINGS = ("<", "<=", ">", ">=")
OPERATORS = (*ORDERINGS, "==", "!=", "in", "not_in", "contains")


def _never() -> Column:
    return F.lit(False)


def _kind(constant) -> str:
    if isinstance(constant, (bool, int, float)):
        return "number"
    return "string" if isinstance(constant, str) else "other"


def _ordered(left: Column, op: str, right) -> Column:
    return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def _integral(column: Column, op: str, constant) -> Column:
    """Integer column against any number, without widening the column, so the scan can use the filter."""
    low, high = -(1 << 63), (1 << 63) - 1
    if constant > high or constant < low:
        above = constant > high
        return F.lit({"<": above, "<=": above, ">": not above, ">=": not above, "==": False}[op])
    whole = math.floor(constant)
    if op == "==":
        return column == F.lit(whole) if whole == constant else _never()
    if whole != constant:
        op = "<=" if op in ("<", "<=") else ">"
    return _ordered(column, op, F.lit(whole))


def _compare(column: Column, dtype: T.DataType, op: str, constant) -> Column:
    """``op`` is an ordering or ``==``; false wherever the comparison makes no sense."""
    kind = _kind(constant)
    if kind == "other" or (isinstance(constant, float) and math.isnan(constant)):
        return _never()
    if isinstance(dtype, T.VariantType):
        if kind == "string":
            plain = F.when(variant_kind(column) == "STRING", F.try_variant_get(column, "$", "string"))
            return F.coalesce(_compare(plain, T.StringType(), op, constant), F.lit(False))
        number = F.when(variant_is_number(column), F.try_variant_get(column, "$", "double")).when(
            variant_kind(column) == "BOOLEAN", F.try_variant_get(column, "$", "boolean").cast("double")
        )
        # Whole numbers are compared as such; as doubles, neighbours above 2^53 would be equal.
        whole = _compare(F.try_variant_get(column, "$", "bigint"), T.LongType(), op, constant)
        test = F.when(variant_kind(column).isin(*INTEGRAL_KINDS), whole).otherwise(_compare(number, T.DoubleType(), op, constant))
        return F.coalesce(test, F.lit(False))
    if isinstance(dtype, T.StringType):
        if kind != "string":
            return _never()
        return column == F.lit(constant) if op == "==" else _ordered(column, op, F.lit(constant))
    if kind != "number":
        return _never()
    if isinstance(constant, bool):
        constant = int(constant)
    if isinstance(dtype, T.BooleanType):
        return _integral(column.cast("int"), op, constant)
    if isinstance(dtype, T.IntegralType) and not math.isinf(constant):
        return _integral(column, op, constant)
    if not isinstance(dtype, T.NumericType):
        return _never()
    right = F.lit(float(constant))
    test = column == right if op == "==" else _ordered(column, op, right)
    # Spark orders NaN above every number; here NaN is not greater than anything.
    fractional = isinstance(dtype, (T.DoubleType, T.FloatType))
    return ~F.isnan(column) & test if fractional and op in (">", ">=") else test


def _member(column: Column, dtype: T.DataType, container) -> Column | None:
    """Membership test; None when the constant is not a container for this type."""
    if isinstance(container, str):
        if isinstance(dtype, T.StringType):
            return F.contains(F.lit(container), column)
        return None
    if not isinstance(container, (list, tuple, dict)):
        return None
    strings = [c for c in container if isinstance(c, str)]
    if isinstance(dtype, T.StringType):
        return column.isin(strings) if strings else _never()
    tests = [_compare(column, dtype, "==", c) for c in container if _kind(c) != "other"]
    found = _never()
    for test in tests:
        found = found | test
    return found


def predicate(column: Column, dtype: T.DataType, op: str, constant) -> Column:
    """True for records to keep; null or false drops them."""
    if op not in OPERATORS:
        raise ValueError(f"unknown filter operator {op!r}; known: {', '.join(OPERATORS)}")
    present = column.isNotNull()
    if op == "contains":
        if not isinstance(constant, str):
            return _never()
        return present & F.contains(as_text(column, dtype), F.lit(constant))
    if op in ("in", "not_in"):
        if isinstance(dtype, T.VariantType) and isinstance(constant, str):
            plain = F.when(variant_kind(column) == "STRING", F.try_variant_get(column, "$", "string"))
            inside = _member(plain, T.StringType(), constant)
        else:
            inside = _member(column, dtype, constant)
        if inside is None:
            return _never()
        return present & (inside if op == "in" else ~inside)
    if op == "!=":
        return present & ~_compare(column, dtype, "==", constant)
    return present & _compare(column, dtype, op, constant)


def compile_filters(spec: dict, schema: T.StructType, root: str | None = None) -> list[Column]:
    """The conjunction of ``filter`` and ``filters`` as a list of conditions."""
    single = spec.get("filter")
    entries = ([single] if single else []) + list(spec.get("filters") or [])
    conditions = []
    for entry in entries:
        found = resolve(schema, entry["field"], root)
        if found is None:
            predicate(F.lit(""), T.StringType(), entry["op"], entry["value"])  # rejects unknown operators
            conditions.append(_never())
        else:
            conditions.append(predicate(*found, entry["op"], entry["value"]))
    return conditions


def filter_records(df, *entries: dict, root: str | None = None):
    """Keep the records that pass every entry."""
    for condition in compile_filters({"filters": list(entries)}, df.schema, root):
        df = df.where(condition)
    return df
