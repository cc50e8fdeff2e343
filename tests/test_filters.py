import math

import pytest
from pyspark.sql import functions as F

from blockloom.plans.filters import OPERATORS, filter_records

ROWS = [
    (0, "5", 5, 5.0, True), (1, "abc", 0, float("nan"), False), (2, None, None, None, None),
    (3, "", -3, 2.5, True), (4, "ABC", 1, 1.0, False), (5, "b", 2**53 + 1, math.inf, None),
]
SCHEMA = "i INT, s STRING, n BIGINT, d DOUBLE, b BOOLEAN"
CONSTANTS = [5, 5.0, 2.5, -3, "5", "abc", "", True, False, None, [5, "5"], ["abc", 2.5], "xabcx", [], {"abc": 1}, 1e300, -1e300, float("nan")]


def plainly(x, op, v):
    """What the operator means, on plain Python values."""
    if x is None:
        return False
    try:
        return {
            "<": lambda: x < v, "<=": lambda: x <= v, ">": lambda: x > v, ">=": lambda: x >= v, "==": lambda: x == v,
            "!=": lambda: x != v, "in": lambda: x in v, "not_in": lambda: x not in v,
            "contains": lambda: v in (str(x)),
        }[op]()
    except (TypeError, ValueError):
        return False


@pytest.mark.parametrize("op", OPERATORS)
def test_every_operator_on_every_type(spark, op):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for position, name in enumerate("sndb", start=1):
        for constant in CONSTANTS:
            got = {r["i"] for r in filter_records(df, {"field": name, "op": op, "value": constant}).select("i").collect()}
            wanted = {r[0] for r in ROWS if plainly(r[position], op, constant)}
            assert got == wanted, (name, op, constant)


@pytest.mark.parametrize("op", OPERATORS)
def test_every_operator_on_json(spark, op):
    import json

    values = [5, 2.5, "5", "abc", "", True, None, 0]
    lines = [(i, json.dumps({"x": v})) for i, v in enumerate(values)] + [(90, "{}")]
    df = spark.createDataFrame(lines, "i INT, s STRING").select("i", F.try_parse_json("s").alias("v"))
    for constant in CONSTANTS:
        got = {r["i"] for r in filter_records(df, {"field": "x", "op": op, "value": constant}, root="v").select("i").collect()}
        assert got == {i for i, v in enumerate(values) if plainly(v, op, constant)}, (op, constant)


def test_conjunction_and_missing_field(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    kept = filter_records(df, {"field": "n", "op": ">", "value": 0}, {"field": "d", "op": "<=", "value": 5})
    assert {r["i"] for r in kept.collect()} == {0, 4}
    assert filter_records(df, {"field": "zz", "op": "!=", "value": 0}).count() == 0


def test_unknown_operator_is_an_error(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for field in ("n", "zz"):
        with pytest.raises(ValueError):
            filter_records(df, {"field": field, "op": "~", "value": 0})


def test_filters_reach_the_scan(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    kept = filter_records(events, {"field": "user_id", "op": ">=", "value": 20.5}, {"field": "value", "op": "<", "value": 10})
    plan = kept.select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(user_id,20)" in plan and "LessThan(value,10.0)" in plan
    assert "props" not in plan.split("ReadSchema")[1]
