import pytest
from pyspark.sql import functions as F

from blockloom.fixed import PRESETS
from blockloom.plans.spec import compile_spec, extract, extract_turns, filter_length, resolve_spec

MESSAGE = "STRUCT<role: STRING, content: STRING, text: STRING>"


def run(spark, rows, schema, spec):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"ord INT, {schema}")
    return {r["ord"]: r["text"] for r in extract(df, spec).collect()}


def chat(spark, messages, **spec):
    spec = {"type": "conversation", "field": "m", "role_key": "role", "content_key": "content", **spec}
    return run(spark, [(messages,)], f"m ARRAY<{MESSAGE}>", spec).get(0)


def test_field_text_and_drop(spark):
    got = run(spark, [("  a ",), ("　",), (None,), ("",), ("0",)], "text STRING", {})
    assert got == {0: "a", 4: "0"}


def test_field_list_number_and_missing(spark):
    assert run(spark, [(["a", "", "b"], 7)], "l ARRAY<STRING>, n INT", {"field": "l"}) == {0: "a\nb"}
    assert run(spark, [(["a"], 7)], "l ARRAY<STRING>, n INT", {"field": "n"}) == {0: "7"}
    assert run(spark, [(["a"], 7)], "l ARRAY<STRING>, n INT", {"field": "zz"}) == {}


def test_conversation_labels(spark):
    turns = [("user", "hi ", None), ("assistant", "yo", None), ("critic BOT", "hm", None), (None, "anon", None), ("", "x", None)]
    got = chat(spark, turns, roles={"user": "User"}, separator="|")
    assert got == "User: hi|Assistant: yo|Critic bot: hm|anon|x"


def test_conversation_first_truthy_content_wins_before_stripping(spark):
    # Blank content hides the good text; empty and missing content do not.
    turns = [("user", "  ", "good"), ("user", "", "used"), ("user", None, "also"), ("user", None, None)]
    assert chat(spark, turns, roles={}, separator="|") == "User: used|User: also"


def test_conversation_options(spark):
    turns = [("system", "s", None), ("user", "u", None), (None, "n", None)]
    assert chat(spark, turns, include_roles=False, separator="|") == "s|u|n"
    assert chat(spark, turns, skip_roles=["system"], separator="|") == "User: u|n"
    assert chat(spark, turns, roles={"user": ""}, skip_roles=["system"], separator="|") == "u|n"
    assert chat(spark, [], roles={}) is None
    assert chat(spark, [None, ("user", " ", None)], roles={}) is None


def test_conversation_from_json_with_stray_items(spark):
    line = '{"conversations": [{"from": "human", "value": "q"}, 5, "x", {"from": "gpt", "value": ["part"]}, {"from": "gpt"}]}'
    df = spark.createDataFrame([(0, line)], "ord INT, s STRING").select("ord", F.try_parse_json("s").alias("v"))
    got = extract(df, PRESETS["sharegpt"], root="v").first()["text"]
    assert got == 'User: q\n\nAssistant: ["part"]'


def test_conversation_on_turn_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "user", "  "), (2, 0, "user", " ")]
    df = spark.createDataFrame(rows, "conv_id INT, turn INT, role STRING, text STRING")
    got = extract_turns(df, {"roles": {"user": "User", "assistant": "Assistant"}}).collect()
    assert [tuple(r) for r in got] == [(1, "User: a\n\nAssistant: b")]


def test_join(spark):
    rows, schema = [(" t ", None, "b"), ("t", " ", "b"), (None, "", " ")], "title STRING, abstract STRING, body STRING"
    spec = {"type": "join", "fields": ["title", "abstract", "body"], "separator": "|"}
    assert run(spark, rows, schema, spec) == {0: "t|b", 1: "t|b"}
    assert run(spark, rows, schema, {**spec, "require_all": True}) == {}
    assert run(spark, rows, schema, {**spec, "labels": {"body": "Body", "title": ""}}) == {0: "t|Body: b", 1: "t|Body: b"}


def test_coalesce(spark):
    rows, schema = [(" ", "b"), (None, None), ("a ", "b")], "x STRING, y STRING"
    assert run(spark, rows, schema, {"type": "coalesce", "fields": ["zz", "x", "y"]}) == {0: "b", 2: "a"}


def test_template(spark):
    schema = "a STRUCT<b: STRING>, b INT, c STRING"
    spec = {"type": "template", "template": "{{{a_b}}} {b} {c}!", "fields": ["a.b", "c"]}
    assert run(spark, [(("x",), 0, " y ")], schema, spec) == {0: "{x} x y!"}
    # Equal last parts: the later field wins. Falsy values are empty.
    assert run(spark, [(("x",), 0, None)], schema, {**spec, "fields": ["a.b", "b", "c"]}) == {0: "{x}  !"}
    assert run(spark, [(("x",), 0, "y")], schema, {**spec, "template": "{unknown}"}) == {}
    assert run(spark, [((None,), 0, None)], schema, {**spec, "template": "{c}{b}"}) == {}
    for bad in ("{a!r}", "{a:>5}", "{}", "{0}", "{a.b}"):
        with pytest.raises(ValueError):
            run(spark, [(("x",), 0, "y")], schema, {**spec, "template": bad})


def test_instruction_templates(spark):
    rows = [("do", "with", "done"), ("do", " ", "done"), ("do", None, None), (" ", "x", "y")]
    full = "### Instruction:\ndo\n\n### {}:\nwith\n\n### Response:\ndone"
    bare = "### Instruction:\ndo\n\n### Response:\ndone"
    assert run(spark, rows, "instruction STRING, input STRING, output STRING", PRESETS["alpaca"]) == {0: full.format("Input"), 1: bare}
    assert run(spark, rows, "instruction STRING, context STRING, response STRING", PRESETS["dolly"]) == {0: full.format("Context"), 1: bare}


def test_score_preset_drops_null_and_nan(spark):
    rows = [("a", 0.4), ("b", 0.5), ("c", None), ("d", float("nan"))]
    assert run(spark, rows, "texts STRING, avg_score DOUBLE", PRESETS["pile_detoxify"]) == {0: "a"}


def test_spec_precedence_and_errors(spark):
    assert resolve_spec("tinystories", '{"type": "join"}') == PRESETS["tinystories"]
    assert resolve_spec(None, '{"type": "join"}', "x") == {"type": "join"}
    assert resolve_spec(None, None, "x") == {"type": "field", "field": "x"}
    with pytest.raises(ValueError):
        resolve_spec("nope")
    with pytest.raises(ValueError):
        resolve_spec(None, "{")
    with pytest.raises(ValueError):
        compile_spec({"type": "nope"}, spark.range(1).schema)


def test_length_bounds(spark):
    df = spark.createDataFrame([("😀😀",), ("abc",), ("abcd",)], "text STRING")
    assert [r[0] for r in filter_length(df, 3, 3).collect()] == ["abc"]
    assert filter_length(df, 0, 0).count() == 3
