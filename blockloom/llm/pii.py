"""Personal data: fixed patterns, and contextual patterns learned from what they find.

Seeds are the identifiers that the fixed patterns find, each as a whole. Candidates are what stands like one: runs of
digits with their separators, and words that hold a digit, an at sign or a sign between letters. The words before a seed
or candidate, with the shape of its characters or with its kind of characters, form its patterns. A pattern is trusted if
nearly all of its distinct instances are known, and enough of them are seeds; a candidate that a trusted pattern vouches
for is known from then on. Patterns are scored over the graph of distinct (pattern, instance) edges, with the seeds fixed
as known, until a round makes nothing known. What became known are the new findings.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned each; repeated edges count
once; an empty table gives an empty result; without seeds nothing new is found. Other columns are not read, whatever their
names; a very long text is walked once per kind by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import SPACE, matches, matches_if, numbered, placed, text_of, with_overlaps
from blockloom.session import materialize

# The patterns of the base kinds. A match may begin where a run begins or the previous match ended;
# possessive runs match the same text without trying it again from every character.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
KINDS = ["email", "ip", "card", "phone", "context"]

NUMBERS = r"[+(]?[0-9](?:(?:[\x20.-]|\x20?\(|\)[\x20-]?)?+[0-9])++"
SIGNED = rf"(?=[^{SPACE}]*?(?:[0-9@]|[\p{{L}}][^\p{{L}}{SPACE}]+\p{{L}}))[^{SPACE}]*[\p{{L}}\p{{N}}]"
INSTANCE = rf"(?<![^{SPACE}])(?:{NUMBERS}(?![^{SPACE}.,;:!?)])|{SIGNED})"
MIN_SEEDS = 5
MIN_TRUST = 0.9


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid() -> Column:
    digits = F.regexp_replace("match", "[^0-9]", "")
    kind = F.col("kind")
    return (
        (kind == "email")
        | ((kind == "ip") & F.regexp_like("match", F.lit(rf"\A{IP_PART}(?:\.{IP_PART}){{3}}\z")))
        | ((kind == "phone") & F.length(digits).between(9, 15))
        | F.when((kind == "card") & F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    )


def edges_of(instances: DataFrame) -> DataFrame:
    """Distinct ``pattern, value, seed``: the one or two words before an instance with its shape, and two with its kind."""
    words = F.regexp_extract_all(F.lower("before"), F.lit(rf"[^{SPACE}]+"), F.lit(0))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[0-9]", "9"), r"\p{L}+", "a"), "9{12,}", "9+")
    kind = F.when(F.contains("value", F.lit("@")), "@").when(F.regexp_like("value", F.lit(r"\p{L}")), "a").otherwise("9")
    rows = instances.select(
        "value", "seed", F.transform(words, lambda w: F.regexp_replace(w, F.lit("[0-9]+"), F.lit("9"))).alias("_w"),
        shape.alias("_shape"), kind.alias("_kind"))
    one, two = F.slice("_w", -1, 1), F.slice("_w", F.greatest(-F.size("_w"), F.lit(-2)), 2)
    patterns = F.array_distinct(F.array(
        F.concat_ws("\t", F.concat_ws(" ", one), "_shape"), F.concat_ws("\t", F.concat_ws(" ", two), "_shape"),
        F.concat_ws("\t", F.concat_ws(" ", two), F.lit("any"), "_kind")))
    rows = rows.where(F.size("_w") > 0).select("value", "seed", F.explode(patterns).alias("pattern"))
    return rows.groupBy("pattern", "value").agg(F.max("seed").alias("seed"))


def trusted_instances(edges: DataFrame, min_seeds: int = MIN_SEEDS, min_trust: float = MIN_TRUST) -> DataFrame:
    """``value`` of instances beyond the seeds that trusted patterns vouch for, directly or through others.

    Patterns are counted by joins over the edge table, pre-aggregated per task; a pattern with a third of all edges is one
    row of the pattern table, and its edges are spread over tasks by their instance. Each round makes something known or
    is the last.
    """
    edges = materialize(edges, "pii-edges")
    values = edges.groupBy("value").agg(F.max("seed").alias("_seed"))
    # Only patterns with enough seeds can ever be trusted, and only their instances matter beyond the seeds.
    marked = edges.drop("seed").join(values, "value")
    sizes = marked.groupBy("pattern").agg(F.count("*").alias("_all"), F.count_if("_seed").alias("_seeds")).where(F.col("_seeds") >= min_seeds)
    marked = materialize(marked.join(sizes, "pattern"), "pii-marked")
    known = materialize(marked.where("_seed").select("value").distinct(), "pii-seeds")
    while True:
        counts = marked.join(known, "value", "left_semi").groupBy("pattern", "_all").agg(F.count("*").alias("_known"))
        trusted = counts.where(F.col("_known") / (F.col("_all") + 1) >= min_trust).select("pattern")
        vouched = marked.where(~F.col("_seed")).join(trusted, "pattern", "left_semi").select("value").distinct()
        new = materialize(vouched.join(known, "value", "left_anti"), "pii-new")
        if new.isEmpty():
            break
        known = materialize(known.unionByName(new), "pii-known")
    return known.join(values.where(~F.col("_seed")), "value", "left_semi")


def personal_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``: the numbered documents, and their spans ``_row, kind, rank, start, end, match``.

    The texts are read once; what was found is written and all later work is on it.
    """
    text = F.col("_text")
    found = materialize(numbered(docs.select("doc_id", text_of().alias("_text"))).select(
        "_row", "doc_id",
        matches_if(F.contains(text, F.lit("@")), text, EMAIL).alias("email"),
        matches_if(F.regexp_like(text, F.lit(r"[0-9]\.[0-9]+\.[0-9]")), text, IP).alias("ip"),
        matches_if(F.regexp_like(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")), text, CARD).alias("card"),
        matches_if(F.contains(text, F.lit("+")), text, PHONE).alias("phone"),
        matches(text, INSTANCE).alias("context"),
    ), "personal")
    spans = materialize(placed(found, KINDS), "personal-spans")
    base = materialize(spans.where(_valid()), "personal-base")
    candidates = materialize(with_overlaps(spans.where("kind = 'context'"), base).where(~F.col("_overlaps")), "personal-candidates")
    instances = base.select(F.col("match").alias("value"), "before", F.lit(True).alias("seed")).unionByName(
        candidates.select(F.col("match").alias("value"), "before", F.lit(False).alias("seed")))
    passed = trusted_instances(edges_of(instances))
    columns = ["_row", "kind", "rank", "start", "end", "match"]
    new = candidates.join(passed.select(F.col("value").alias("match")), "match", "left_semi")
    return found.select("_row", "doc_id"), base.select(columns).unionByName(new.select(columns))
