"""The registered queries of this subpackage, with their SQL counterparts where SQL can express them."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from blockloom.llm import (
    collocations, decontaminate, divergence, exact, licenses, lines, mixing, packing, pii, secrets, simhash, tokenfile,
    toxicity)
from blockloom.llm.common import table

#: The tokenizer of the token queries; another file may be named.
TOKENIZER = os.environ.get("BLOCKLOOM_TOKENIZER") or public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(table(spark, sf_dir, "documents")).drop("_row")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digests(*secrets.secret_spans(table(spark, sf_dir, "documents")), secrets.KINDS[:3])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.selectExpr("doc_id", "lpad(lower(hex(fp)), 16, '0') AS fingerprint", "component_id")


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_table(table(spark, sf_dir, "documents"), TOKENIZER)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).drop("_row")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_hits(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digests(*pii.personal_spans(table(spark, sf_dir, "documents")), pii.KINDS[:4])


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), TOKENIZER, with_ids=False)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES = {q.__name__: q for q in (
    op1_mixing, op2_line_dedup, op3_toxicity, op4_secrets, op5_simhash, op6_token_file, op7_exact_dedup,
    op8_decontamination, op9_licenses, op10_pii, op11_collocations, op12_packing, op13_divergence,
)}

_BARE = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"
_SPELLED = "regexp_replace(lower(coalesce(text, '')), '(?m)^[^\\n]*(?:copyright +[(0-9]|\\(c\\) +[0-9]|©|all rights reserved)[^\\n]*$', '', 'g')"
_SPELLED = f"regexp_replace({_SPELLED}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
for _variant, _usual in licenses.SPELLINGS.items():
    _SPELLED = f"regexp_replace({_SPELLED}, '\\b{_variant}\\b', '{_usual}', 'g')"
_KNOWN = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.KNOWN.items())

ORACLES = {
    "op7_exact_dedup": f"""
        WITH bare AS (SELECT doc_id, length(coalesce(text, '')) AS n, {_BARE} AS t FROM documents)
        SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER g = 1 AS kept, sha256(t) AS text_sha256
        FROM bare WINDOW g AS (PARTITION BY t ORDER BY n DESC, doc_id)
    """,
    "op9_licenses": f"""
        WITH known AS (
            SELECT license_id, trim(regexp_replace({_SPELLED}, '[ \\n]+', ' ', 'g')) AS t FROM (VALUES {_KNOWN}) AS k(license_id, text)
        ), texts AS (SELECT doc_id, {_SPELLED} AS t FROM documents),
        units AS (
            SELECT doc_id, trim(regexp_replace(t, '[ \\n]+', ' ', 'g')) AS t, NULL::INT AS line FROM texts
            UNION ALL
            SELECT doc_id, trim(l) AS t, line FROM (
                SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line FROM texts)
        )
        SELECT doc_id, license_id, line FROM units JOIN known USING (t) WHERE t <> ''
    """,
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        grams AS (
            SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS g
            FROM lists, range(1, 5) AS lengths(m) WHERE len(w) >= m
        ), f AS MATERIALIZED (SELECT lang, m, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
        cuts AS (
            SELECT lang, m, g, f AS a, k, array_to_string(string_split(g, ' ')[:k], ' ') AS h, array_to_string(string_split(g, ' ')[k + 1:], ' ') AS t
            FROM f, range(1, 4) AS places(k) WHERE k < m
        ), scored AS (
            SELECT c.lang, c.m, c.g, c.a, c.k, h.f AS l, t.f AS r, ((2000000::HUGEINT * c.a) // (h.f + t.f))::BIGINT AS score
            FROM cuts c JOIN f h ON h.lang = c.lang AND h.g = c.h JOIN f t ON t.lang = c.lang AND t.g = c.t
        ), best AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
        ), holders AS (
            SELECT lang, g, max(f) AS held FROM (
                SELECT lang, f, unnest(list_transform(range(1, m - s + 2), lambda i: array_to_string(string_split(f.g, ' ')[i:i + s - 1], ' '))) AS g
                FROM f, range(2, 4) AS sizes(s) WHERE m > s)
            GROUP BY ALL
        ), ranked AS (
            SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.g) AS rank
            FROM best b LEFT JOIN holders h ON h.lang = b.lang AND h.g = b.g WHERE h.held IS NULL OR 100 * h.held < 80 * a
        )
        SELECT lang, rank, g AS phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
    "op13_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
        ), o AS MATERIALIZED (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS MATERIALIZED (SELECT lang, term, count(*) AS lc FROM o GROUP BY ALL HAVING count(DISTINCT row) >= 30),
        langs AS (SELECT lang, count(*) AS v, sum(lc) AS ln FROM kept GROUP BY lang),
        c AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        groups AS MATERIALIZED (
            SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS gn FROM (SELECT DISTINCT lang, source FROM d) g
            LEFT JOIN c USING (lang, source) GROUP BY ALL
        ), cells AS MATERIALIZED (
            SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
                   (1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (g.gn + 5 * l.v))::BIGINT AS p,
                   (1 + (1000000000::HUGEINT * (k.lc + 5)) // (l.ln + 5 * l.v))::BIGINT AS q
            FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
            LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), sums AS (
            SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p))::BIGINT AS value
            FROM cells x JOIN cells y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
        ), found AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, p - q FROM cells WHERE c > 0 AND p > q
        ), ranked AS (
            SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM found
        )
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
}
