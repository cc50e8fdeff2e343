"""Field extraction, filters, length and prefix dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.catalog.common import TEXT_FACTS, documents, strip_sql, table, text_facts
from blockloom.fixed import OPENAI_ROLES, PRESETS
from blockloom.operators.dedupe import dedupe_prefix
from blockloom.operators.stats import drop_reasons
from blockloom.plans.filters import compile_filters, filter_records
from blockloom.plans.paths import resolve
from blockloom.plans.spec import compile_spec, extract, extract_turns, filter_length


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as records with a nested part."""
    return table(spark, sf_dir, "pages").select(
        "page_id", "url",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.struct(
            F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"),
            F.array_join(F.regexp_extract_all("html", F.lit("<p>([^<]*)")), "\n").alias("paragraphs"), F.lit(0).alias("zero"),
        ).alias("body"),
    )


_PAGES = """pg AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
                          regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading,
                          array_to_string(regexp_extract_all(html, '<p>([^<]*)', 1), chr(10)) AS paragraphs FROM pages)"""


def _messages(spark: SparkSession, sf_dir: str, role: str, content: str, field: str) -> DataFrame:
    """Conversations as one record each, with a list of messages."""
    shown = F.col("role")
    if role == "from":
        shown = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    turn = F.struct("turn", shown.alias(role), F.col("text").alias(content))
    ordered = F.sort_array(F.collect_list(turn))
    messages = F.transform(ordered, lambda t: F.struct(t[role].alias(role), t[content].alias(content)))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(messages.alias(field))


def _asked(spark: SparkSession, sf_dir: str, option: str, answer: str) -> DataFrame:
    """Every user turn with the assistant turn right after it, and the conversation's first system turn, if any."""
    turns = table(spark, sf_dir, "conversations")
    told = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias(answer))
    given = turns.where("role = 'system'").groupBy("conv_id").agg(F.min_by("text", "turn").alias(option))
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    return asked.join(told, ["conv_id", "turn"]).join(given, "conv_id", "left")


def nested_path(spark, sf_dir):
    records = table(spark, sf_dir, "documents").select(
        "doc_id", F.struct("lang", "source").alias("meta"), F.split("text", "\n").alias("lines"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("tags"),
    )
    paths = {
        "lang": "meta.lang", "first_line": "lines.0", "last_line": "lines.-1", "far_line": "lines.100000",
        "no_key": "meta.none", "through_list": "lines.text", "tag": "tags.lang", "no_tag": "tags.none",
    }
    values = []
    for name, path in paths.items():
        found = resolve(records.schema, path)
        values.append((F.lit(None).cast("string") if found is None else found[0]).alias(name))
    return records.select("doc_id", *values)


def nested_json(spark, sf_dir):
    records = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    value, _ = resolve(records.schema, "k", root="v")
    missing, _ = resolve(records.schema, "k.deeper.0", root="v")
    return records.select(
        "event_id", F.try_variant_get(value, "$", "bigint").alias("k"),
        F.try_variant_get(missing, "$", "string").alias("deeper"),
    )


def extract_field(spark, sf_dir):
    records = table(spark, sf_dir, "documents").select("doc_id", F.struct(F.split("text", "\n").alias("lines")).alias("body"))
    docs = extract(records, {"type": "field", "field": "body.lines"}, carry=("doc_id",))
    return docs.select("doc_id", *text_facts())


CHAT = {"roles": OPENAI_ROLES, "separator": "\n\n", "include_roles": True, "skip_roles": ["system"]}


def extract_conversation(spark, sf_dir):
    return extract_turns(table(spark, sf_dir, "conversations"), CHAT).select("conv_id", *text_facts())


def preset_openai_messages(spark, sf_dir):
    records = _messages(spark, sf_dir, "role", "content", "messages")
    return extract(records, PRESETS["openai_messages"], carry=("conv_id",)).select("conv_id", *text_facts())


def preset_sharegpt(spark, sf_dir):
    records = _messages(spark, sf_dir, "from", "value", "conversations")
    return extract(records, PRESETS["sharegpt"], carry=("conv_id",)).select("conv_id", *text_facts())


def _chat_sql(where: str = "true") -> str:
    label = "CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'System' END"
    return f"""
    WITH t AS (SELECT conv_id, turn, {label} || ': ' || {strip_sql('text')} AS part FROM conversations
               WHERE {where} AND {strip_sql('text')} <> ''),
         g AS (SELECT conv_id, string_agg(part, chr(10) || chr(10) ORDER BY turn) AS text FROM t GROUP BY conv_id)
    SELECT conv_id, {TEXT_FACTS} FROM g"""


def preset_pile_detoxify(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    score = (F.col("toxic") * F.lit(0.75) + F.col("quality") * F.lit(0.125)).alias("avg_score")
    records = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        "doc_id", F.col("text").alias("texts"), score
    )
    return extract(records, PRESETS["pile_detoxify"], carry=("doc_id",)).select("doc_id", *text_facts())


def preset_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    parts = [
        extract(docs, PRESETS[name], carry=("doc_id",)).select(F.lit(name).alias("preset"), "doc_id", *text_facts())
        for name in ("arxiv_tex", "tinystories", "openwebtext")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


JOIN = {"type": "join", "fields": ["title", "body.heading", "body.paragraphs", "url"], "separator": "\n\n", "labels": {"url": "Source"}}


def extract_join(spark, sf_dir):
    records = _pages(spark, sf_dir)
    some = extract(records, JOIN, carry=("page_id",)).select("page_id", F.lit(False).alias("all_fields"), *text_facts())
    every = extract(records, {**JOIN, "require_all": True}, carry=("page_id",))
    return some.unionByName(every.select("page_id", F.lit(True).alias("all_fields"), *text_facts()))


def extract_coalesce(spark, sf_dir):
    spec = {"type": "coalesce", "fields": ["missing", "body.paragraphs", "body.heading", "title", "url"]}
    return extract(_pages(spark, sf_dir), spec, carry=("page_id",)).select("page_id", *text_facts())


def extract_template(spark, sf_dir):
    spec = {
        "type": "template", "template": "Title: {title}\n\n{body_heading}|{heading} {{{zero}}} {url}\n{body_paragraphs}",
        "fields": ["title", "body.heading", "body.zero", "url", "body.paragraphs"],
    }
    return extract(_pages(spark, sf_dir), spec, carry=("page_id",)).select("page_id", *text_facts())


def extract_alpaca(spark, sf_dir):
    records = _asked(spark, sf_dir, "input", "output")
    return extract(records, PRESETS["alpaca"], carry=("conv_id", "turn")).select("conv_id", "turn", *text_facts())


def extract_dolly(spark, sf_dir):
    records = _asked(spark, sf_dir, "context", "response")
    return extract(records, PRESETS["dolly"], carry=("conv_id", "turn")).select("conv_id", "turn", *text_facts())


def _section_sql(heading: str) -> str:
    def clean(text: str) -> str:
        return f"coalesce({strip_sql(text)}, '')"

    return f"""
    WITH s AS (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'system' GROUP BY conv_id),
         r AS (SELECT u.conv_id, u.turn, {clean('u.text')} AS asked, {clean('s.text')} AS given, {clean('a.text')} AS told
               FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
               LEFT JOIN s ON s.conv_id = u.conv_id WHERE u.role = 'user'),
         x AS (SELECT conv_id, turn, '### Instruction:' || chr(10) || asked
                 || CASE WHEN given <> '' THEN chr(10) || chr(10) || '### {heading}:' || chr(10) || given ELSE '' END
                 || chr(10) || chr(10) || '### Response:' || chr(10) || told AS text
               FROM r WHERE asked <> '' AND told <> '')
    SELECT conv_id, turn, {TEXT_FACTS} FROM x"""


def _flags(df: DataFrame, key: str, tests: dict[str, dict], root: str | None = None) -> DataFrame:
    """All records with one truth value per filter."""
    columns = [
        F.coalesce(compile_filters({"filter": entry}, df.schema, root)[0], F.lit(False)).alias(name)
        for name, entry in tests.items()
    ]
    return df.select(key, *columns)


def filter_compare(spark, sf_dir):
    return _flags(table(spark, sf_dir, "events"), "event_id", {
        "value_lt": {"field": "value", "op": "<", "value": 10},
        "value_le": {"field": "value", "op": "<=", "value": 6.55},
        "value_gt": {"field": "value", "op": ">", "value": 10.5},
        "user_ge": {"field": "user_id", "op": ">=", "value": 20.5},
        "type_eq": {"field": "event_type", "op": "==", "value": "click"},
        "type_ne": {"field": "event_type", "op": "!=", "value": "click"},
        "mixed_lt": {"field": "event_type", "op": "<", "value": 5},
        "mixed_ne": {"field": "event_type", "op": "!=", "value": 5},
    })


def filter_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    kept = filter_records(docs, {"field": "quality", "op": "!=", "value": 0}, {"field": "toxic", "op": "not_in", "value": [1]})
    return kept.select("doc_id", "quality", "toxic")


def filter_in(spark, sf_dir):
    return _flags(table(spark, sf_dir, "events"), "event_id", {
        "type_in": {"field": "event_type", "op": "in", "value": ["click", "view", 7]},
        "type_not_in": {"field": "event_type", "op": "not_in", "value": ["click", "view"]},
        "user_in": {"field": "user_id", "op": "in", "value": [1, 2.0, "3", True]},
        "type_in_text": {"field": "event_type", "op": "in", "value": "a click or a view"},
        "user_in_text": {"field": "user_id", "op": "not_in", "value": "123"},
    })


def filter_contains(spark, sf_dir):
    return _flags(table(spark, sf_dir, "events"), "event_id", {
        "type_has": {"field": "event_type", "op": "contains", "value": "i"},
        "user_has": {"field": "user_id", "op": "contains", "value": "4"},
        "pattern": {"field": "event_type", "op": "contains", "value": ".*"},
    })


def filter_conjunction(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    spec = {
        "filter": {"field": "value", "op": "<", "value": 50},
        "filters": [
            {"field": "event_type", "op": "in", "value": ["click", "purchase"]},
            {"field": "user_id", "op": ">", "value": 5},
        ],
    }
    for condition in compile_filters(spec, events.schema):
        events = events.where(condition)
    return events.select("event_id", "user_id", "event_type", "value")


def filter_json(spark, sf_dir):
    records = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return _flags(records, "event_id", {
        "k_lt": {"field": "k", "op": "<", "value": 30},
        "k_eq": {"field": "k", "op": "==", "value": 69},
        "k_ne_text": {"field": "k", "op": "!=", "value": "69"},
        "k_in": {"field": "k", "op": "in", "value": [1, 2, 3]},
        "k_has": {"field": "k", "op": "contains", "value": "7"},
        "none": {"field": "other", "op": "!=", "value": 1},
    }, root="v")


def drop_reasons_query(spark, sf_dir):
    """What the steps before dedupe do to every document of a score-filtered run."""
    records = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    compiled = compile_spec({"field": "text", "filter": {"field": "quality", "op": "==", "value": 1}}, records.schema)
    return drop_reasons(records, compiled.conditions[0], compiled.text, 64, 5000)


def filter_length_query(spark, sf_dir):
    return filter_length(documents(spark, sf_dir), 64, 5000).select(F.col("ord").alias("doc_id"), *text_facts())


def dedupe_prefix_query(spark, sf_dir):
    docs = filter_length(documents(spark, sf_dir), 64, 0)
    return dedupe_prefix(docs, 64).select(F.col("ord").alias("doc_id"), *text_facts())


QUERIES = {
    "nested_path": nested_path,
    "nested_json": nested_json,
    "extract_field": extract_field,
    "extract_conversation": extract_conversation,
    "extract_join": extract_join,
    "extract_coalesce": extract_coalesce,
    "extract_template": extract_template,
    "extract_alpaca": extract_alpaca,
    "extract_dolly": extract_dolly,
    "preset_text": preset_text,
    "preset_sharegpt": preset_sharegpt,
    "preset_openai_messages": preset_openai_messages,
    "preset_pile_detoxify": preset_pile_detoxify,
    "filter_compare": filter_compare,
    "filter_scores": filter_scores,
    "filter_in": filter_in,
    "filter_contains": filter_contains,
    "filter_conjunction": filter_conjunction,
    "filter_json": filter_json,
    "drop_reasons": drop_reasons_query,
    "filter_length": filter_length_query,
    "dedupe_prefix": dedupe_prefix_query,
}

_HEADING = strip_sql("heading")
_TITLE = strip_sql("title")
_URL = strip_sql("url")
_PARAGRAPHS = strip_sql("paragraphs")
_JOINED = f"""concat_ws(chr(10) || chr(10), nullif({_TITLE}, ''), nullif({_HEADING}, ''), nullif({_PARAGRAPHS}, ''), 'Source: ' || nullif({_URL}, ''))"""

ORACLES = {
    "nested_path": """
        SELECT doc_id, lang, l[1] AS first_line, l[-1] AS last_line, CAST(NULL AS VARCHAR) AS far_line,
               CAST(NULL AS VARCHAR) AS no_key, CAST(NULL AS VARCHAR) AS through_list, lang AS tag,
               CAST(NULL AS VARCHAR) AS no_tag
        FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents)""",
    "nested_json": """
        SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS deeper FROM events""",
    "extract_field": f"""
        WITH x AS (SELECT doc_id, {strip_sql("array_to_string(list_filter(string_split(text, chr(10)), lambda l: l <> ''), chr(10))")} AS text
                   FROM documents)
        SELECT doc_id, {TEXT_FACTS} FROM x WHERE text <> ''""",
    "extract_conversation": _chat_sql("role <> 'system'"),
    "preset_openai_messages": _chat_sql(),
    "preset_sharegpt": _chat_sql(),
    "preset_pile_detoxify": f"""
        WITH x AS (SELECT d.doc_id, {strip_sql('d.text')} AS text FROM documents d JOIN labels l USING (doc_id)
                   WHERE l.toxic * 0.75 + l.quality * 0.125 < 0.5)
        SELECT doc_id, {TEXT_FACTS} FROM x WHERE text <> ''""",
    "preset_text": f"""
        WITH x AS (SELECT doc_id, {strip_sql('text')} AS text FROM documents)
        SELECT preset, doc_id, {TEXT_FACTS} FROM x, (VALUES ('arxiv_tex'), ('tinystories'), ('openwebtext')) p(preset)
        WHERE text <> ''""",
    "extract_join": f"""
        WITH {_PAGES},
             x AS (SELECT page_id, false AS all_fields, {strip_sql(_JOINED)} AS text FROM pg
                   UNION ALL SELECT page_id, true, {strip_sql(_JOINED)} FROM pg
                   WHERE {_TITLE} <> '' AND {_HEADING} <> '' AND {_PARAGRAPHS} <> '' AND {_URL} <> '')
        SELECT page_id, all_fields, {TEXT_FACTS} FROM x WHERE text <> ''""",
    "extract_coalesce": f"""
        WITH {_PAGES},
             x AS (SELECT page_id, coalesce(nullif({_PARAGRAPHS}, ''), nullif({_HEADING}, ''), nullif({_TITLE}, ''), nullif({_URL}, '')) AS text FROM pg)
        SELECT page_id, {TEXT_FACTS} FROM x WHERE text <> ''""",
    "extract_template": f"""
        WITH {_PAGES},
             x AS (SELECT page_id, {strip_sql(f"'Title: ' || {_TITLE} || chr(10) || chr(10) || {_HEADING} || '|' || {_HEADING} || ' {{}} ' || {_URL} || chr(10) || {_PARAGRAPHS}")} AS text FROM pg)
        SELECT page_id, {TEXT_FACTS} FROM x WHERE text <> ''""",
    "extract_alpaca": _section_sql("Input"),
    "extract_dolly": _section_sql("Context"),
    "filter_compare": """
        SELECT event_id, value < 10 AS value_lt, value <= 6.55 AS value_le, value > 10.5 AS value_gt,
               user_id >= 20.5 AS user_ge, event_type = 'click' AS type_eq, event_type <> 'click' AS type_ne,
               false AS mixed_lt, true AS mixed_ne FROM events""",
    "filter_scores": """
        SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE quality <> 0 AND toxic <> 1""",
    "filter_in": """
        SELECT event_id, event_type IN ('click', 'view') AS type_in, event_type NOT IN ('click', 'view') AS type_not_in,
               user_id IN (1, 2) AS user_in, contains('a click or a view', event_type) AS type_in_text,
               false AS user_in_text FROM events""",
    "filter_contains": """
        SELECT event_id, contains(event_type, 'i') AS type_has, contains(CAST(user_id AS VARCHAR), '4') AS user_has,
               false AS pattern FROM events""",
    "filter_conjunction": """
        SELECT event_id, user_id, event_type, value FROM events
        WHERE value < 50 AND event_type IN ('click', 'purchase') AND user_id > 5""",
    "filter_json": """
        SELECT event_id, k < 30 AS k_lt, k = 69 AS k_eq, true AS k_ne_text, k IN (1, 2, 3) AS k_in,
               contains(CAST(k AS VARCHAR), '7') AS k_has, false AS "none"
        FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""",
    "drop_reasons": f"""
        WITH x AS (SELECT quality, length({strip_sql('text')}) AS n FROM documents LEFT JOIN labels USING (doc_id))
        SELECT CASE WHEN quality IS NULL OR quality <> 1 THEN 'filtered' WHEN n = 0 THEN 'no_text' WHEN n < 64 THEN 'too_short'
                    WHEN n > 5000 THEN 'too_long' ELSE 'kept' END AS reason, count(*) AS n_records FROM x GROUP BY 1""",
    "filter_length": f"""
        SELECT doc_id, {TEXT_FACTS} FROM documents WHERE length(text) BETWEEN 64 AND 5000""",
    "dedupe_prefix": f"""
        SELECT doc_id, {TEXT_FACTS} FROM documents WHERE length(text) >= 64
        QUALIFY row_number() OVER (PARTITION BY left(text, 64) ORDER BY doc_id) = 1""",
}
