import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.fixed import WHITESPACE
from blockloom.functions.text import as_text, capitalize, join_items, strip, truthy
from blockloom.plans.paths import resolve


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, s STRING")


def column(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_strip_matches_python_on_every_space(spark):
    values = [c + "a b" + c for c in WHITESPACE] + ["　\x85\x1c\t x \xa0", "   ", "", "a​", "﻿a", "😀 "]
    assert column(texts(spark, values), strip(F.col("s"))) == [v.strip() for v in values]


def test_whitespace_is_complete():
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_lengths_are_code_points(spark):
    assert column(texts(spark, ["😀é", ""]), F.length("s")) == [2, 0]


def test_capitalize_lowers_the_rest(spark):
    values = ["user", "USER", "some one ELSE", "", "éa"]
    assert column(texts(spark, values), capitalize(F.col("s"))) == [v.capitalize() for v in values]


def test_truthiness(spark):
    df = spark.createDataFrame(
        [(0, "", 0, 0.0, False, []), (1, "0", 1, float("nan"), True, ["x"]), (2, None, None, None, None, None)],
        "i INT, s STRING, n INT, d DOUBLE, b BOOLEAN, a ARRAY<STRING>",
    )
    for name in "sndba":
        assert column(df, truthy(F.col(name), df.schema[name].dataType)) == [False, True, False]


def test_list_text_skips_falsy_items(spark):
    df = spark.createDataFrame([(0, ["a", "", None, "b"], [1, 0, 2])], "i INT, s ARRAY<STRING>, n ARRAY<INT>")
    assert column(df, join_items(F.col("s"), T.StringType())) == ["a\nb"]
    assert column(df, join_items(F.col("n"), T.IntegerType())) == ["1\n2"]


def test_boolean_text(spark):
    df = spark.createDataFrame([(0, True), (1, False)], "i INT, b BOOLEAN")
    assert column(df, as_text(F.col("b"), T.BooleanType())) == ["True", "False"]


def test_paths_on_typed_records(spark):
    df = spark.createDataFrame(
        [(0, {"x": {"y": [{"z": "a"}, {"z": "b"}]}, "m": None}, {"k": "v"}), (1, None, None)],
        "i INT, r STRUCT<x: STRUCT<y: ARRAY<STRUCT<z: STRING>>>, m: STRING>, t MAP<STRING, STRING>",
    )
    wanted = {
        "r.x.y.0.z": ["a", None], "r.x.y.-1.z": ["b", None], "r.x.y.-3.z": [None, None], "r.x.y.2.z": [None, None],
        "t.k": ["v", None], "t.q": [None, None], "r.m": [None, None],
    }
    for path, values in wanted.items():
        assert column(df, resolve(df.schema, path)[0]) == values, path
    # A key into a list, a missing field, a step into text.
    assert resolve(df.schema, "r.x.y.z") is None
    assert resolve(df.schema, "nope") is None
    assert resolve(df.schema, "r.m.deeper") is None


def test_paths_on_json_records(spark):
    record = {"a": {"b": [10, {"c": "x"}], "0": "zero"}, "q's": 1, "n": None, "b'\"": 2}
    lines = [json.dumps(record), '{"a": 5}']
    df = texts(spark, lines).select("i", F.try_parse_json("s").alias("v"))

    def get(path):
        value, dtype = resolve(df.schema, path, root="v")
        return column(df, as_text(value, dtype))

    assert get("a.b.0") == ["10", None]
    assert get("a.b.-1.c") == ["x", None]
    assert get("a.b.9") == [None, None]
    assert get("a.0") == ["zero", None]
    assert get("q's") == ["1", None]
    assert get('b\'"') == ["2", None]
    assert get("n") == [None, None]
    assert get("a") == ['{"0":"zero","b":[10,{"c":"x"}]}', "5"]
