"""Field-map specs: declarative rules that turn a record into one text.

A spec is compiled once against the schema of the records. The result is a set of built-in Column
expressions, so extraction runs inside the scan stage and Catalyst prunes every column the spec does not name.
"""

from __future__ import annotations

import json
import string
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.fixed import CONTENT_KEYS, PRESETS, SECTION_MODES
from blockloom.functions.text import (
    all_of, as_text, capitalize, join_items, nonblank, strip, truthy, variant_items, variant_kind,
)
from blockloom.plans.filters import compile_filters
from blockloom.plans.paths import Value, child, resolve


def resolve_spec(
    preset: str | None = None, field_map: str | dict | None = None, text_field: str = "text"
) -> dict:
    """The spec in force: a preset wins over a field map, a field map over a plain field name."""
    if preset:
        if preset not in PRESETS:
            raise ValueError(f"unknown preset {preset!r}; known: {', '.join(PRESETS)}")
        return dict(PRESETS[preset])
    if field_map:
        if isinstance(field_map, dict):
            return dict(field_map)
        try:
            return json.loads(field_map)
        except json.JSONDecodeError as error:
            raise ValueError(f"field map is no valid JSON: {error}") from error
    return {"type": "field", "field": text_field}


@dataclass
class Records:
    """What a compiler needs to know about the input: its schema, and the VARIANT column of JSON records."""

    schema: T.StructType
    root: str | None = None

    def value(self, path: str) -> Value | None:
        return resolve(self.schema, path, self.root)

    def text(self, path: str) -> Column:
        found = self.value(path)
        return F.lit(None).cast("string") if found is None else as_text(*found)

    def text_if_truthy(self, path: str) -> Column:
        """Stripped text of a truthy value, empty text otherwise."""
        found = self.value(path)
        if found is None:
            return F.lit("")
        return F.when(truthy(*found), strip(as_text(*found))).otherwise(F.lit(""))


@dataclass
class CompiledSpec:
    """Conditions on the record, and its text; the text is null or blank for records without one."""

    text: Column
    conditions: list[Column] = field(default_factory=list)


def _field(spec: dict, records: Records) -> Column:
    found = records.value(spec.get("field", "text"))
    if found is None:
        return F.lit(None).cast("string")
    value, dtype = found
    if isinstance(dtype, T.ArrayType):
        return join_items(value, dtype.elementType)
    if isinstance(dtype, T.VariantType):
        listed = F.when(variant_kind(value).startswith("ARRAY"), join_items(variant_items(value), dtype))
        return F.coalesce(listed, as_text(value, dtype))
    return as_text(value, dtype)


def _turn_parts(message: Column, dtype: T.DataType, spec: dict) -> tuple[Column, Column]:
    """Role (null when there is none) and content (null when blank) of one message."""
    found_role = child(message, dtype, spec.get("role_key", "from"))
    role = F.lit("") if found_role is None else as_text(*found_role)
    keys = list(dict.fromkeys([spec.get("content_key", "value"), *CONTENT_KEYS]))
    candidates = [c for c in (child(message, dtype, key) for key in keys) if c is not None]
    # The first truthy candidate counts, also when stripping then leaves nothing of it.
    content = F.coalesce(
        *[F.when(truthy(*c), as_text(*c)) for c in candidates], F.lit(None).cast("string")
    )
    return role, nonblank(content)


def render_turn(role: Column, content: Column, spec: dict) -> Column:
    """``Label: content``, or null for a turn that is left out. ``content`` is null when blank."""
    label = F.coalesce(capitalize(role), F.lit(""))
    for name, shown in reversed(list((spec.get("roles") or {}).items())):
        label = F.when(role == name, F.lit(shown)).otherwise(label)
    skipped = [r for r in (spec.get("skip_roles") or []) if r is not None]
    turn = content
    if spec.get("include_roles", True):
        turn = F.when(label != "", F.concat(label, F.lit(": "), content)).otherwise(content)
    if skipped:
        turn = F.when(~F.coalesce(role.isin(skipped), F.lit(False)), turn)
    return turn


def _conversation(spec: dict, records: Records) -> Column:
    found = records.value(spec.get("field", "conversations"))
    nothing = F.lit(None).cast("string")
    if found is None:
        return nothing
    value, dtype = found
    if isinstance(dtype, T.VariantType):
        value, element = variant_items(value), dtype
    elif isinstance(dtype, T.ArrayType):
        element = dtype.elementType
    else:
        return nothing
    if not isinstance(element, (T.StructType, T.MapType, T.VariantType)):
        return nothing
    turns = F.transform(value, lambda message: render_turn(*_turn_parts(message, element, spec), spec))
    return F.nullif(F.array_join(turns, spec.get("separator", "\n\n")), F.lit(""))


def _join(spec: dict, records: Records) -> Column:
    labels = spec.get("labels") or {}
    parts, plain = [], []
    for name in spec.get("fields", []):
        text = nonblank(records.text(name))
        plain.append(text)
        parts.append(F.concat(F.lit(f"{labels[name]}: "), text) if labels.get(name) else text)
    if not parts:
        return F.lit(None).cast("string")
    joined = F.nullif(F.concat_ws(spec.get("separator", "\n\n"), *parts), F.lit(""))
    if spec.get("require_all", False):
        return F.when(all_of([p.isNotNull() for p in plain]), joined)
    return joined


def _coalesce(spec: dict, records: Records) -> Column:
    names = spec.get("fields", [])
    return F.coalesce(*[nonblank(records.text(n)) for n in names], F.lit(None).cast("string"))


def _fill(template: str, values: dict[str, Column]) -> Column:
    """``str.format`` with plain placeholders as one ``concat``; null when a placeholder has no value."""
    pieces = []
    for literal, name, form, conversion in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is None:
            continue
        if not name.isidentifier() or form or conversion:
            raise ValueError(f"template placeholder {name!r}: only plain {{name}} is supported")
        if name not in values:
            return F.lit(None).cast("string")
        pieces.append(values[name])
    return F.nullif(F.concat(*pieces), F.lit("")) if pieces else F.lit(None).cast("string")


def _sectioned(spec: dict, records: Records, option: str, heading: str, answer: str) -> Column:
    """Instruction templates whose middle section appears only when its field has text."""
    asked, given, told = (records.text_if_truthy(n) for n in ("instruction", option, answer))
    section = F.when(given != "", F.concat(F.lit(f"\n\n{heading}\n"), given)).otherwise(F.lit(""))
    filled = _fill(
        spec.get("template", ""), {"instruction": asked, f"{option}_section": section, answer: told}
    )
    return F.when((asked != "") & (told != ""), filled)


def _template(spec: dict, records: Records) -> Column:
    for mode, (option, heading, answer) in SECTION_MODES.items():
        if spec.get(mode):
            return _sectioned(spec, records, option, heading, answer)
    names = spec.get("fields", [])
    values = {name.replace(".", "_"): records.text_if_truthy(name) for name in names}
    values.update({name.split(".")[-1]: records.text_if_truthy(name) for name in names})
    return _fill(spec.get("template", ""), values)


KINDS = {
    "field": _field,
    "conversation": _conversation,
    "join": _join,
    "coalesce": _coalesce,
    "template": _template,
}


def compile_spec(spec: dict, schema: T.StructType, root: str | None = None) -> CompiledSpec:
    """Compile a spec; unknown types and operators are errors here, before any data is read."""
    kind = spec.get("type", "field")
    if kind not in KINDS:
        raise ValueError(f"unknown field map type {kind!r}; known: {', '.join(KINDS)}")
    records = Records(schema, root)
    return CompiledSpec(
        text=strip(KINDS[kind](spec, records)), conditions=compile_filters(spec, schema, root)
    )


def extract(df: DataFrame, spec: dict, carry: tuple[str, ...] = ("ord",), root: str | None = None) -> DataFrame:
    """The ``carry`` columns and ``text`` of every record that passes the filters and has text.

    Blank texts go as the items of a one-element list. As a plain filter the condition, and any later one on the
    text, would be pushed below the projection and evaluate the whole extraction once more each.
    """
    compiled = compile_spec(spec, df.schema, root)
    for condition in compiled.conditions:
        df = df.where(condition)
    text = F.explode(F.array_remove(F.array(compiled.text), ""))
    return df.select(*carry, text.alias("text")).where(F.col("text").isNotNull())


def extract_turns(
    df: DataFrame, spec: dict, key: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text"
) -> DataFrame:
    """Conversation text when every turn is a row of its own: ``(key, text)``.

    Blank and skipped turns go before the shuffle. A group is one conversation, the same text a record would hold.
    """
    turns = df.select(key, turn, render_turn(F.col(role), nonblank(F.col(content)), spec).alias("part"))
    ordered = F.sort_array(F.collect_list(F.struct(turn, "part")))
    text = F.array_join(F.transform(ordered, lambda t: t["part"]), spec.get("separator", "\n\n"))
    return (
        turns.where(F.col("part").isNotNull())
        .groupBy(key).agg(strip(text).alias("text"))
        .where(F.col("text") != "")
    )


def filter_length(df: DataFrame, min_chars: int = 64, max_chars: int = 0, text: str = "text") -> DataFrame:
    """Keep texts of at least ``min_chars`` and, unless 0, at most ``max_chars`` code points."""
    n = F.length(text)
    df = df.where(n >= min_chars)
    return df.where(n <= max_chars) if max_chars else df
