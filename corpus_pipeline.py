"""A training corpus from raw documents: five stages, each an operator of ``blockloom.llm`` over all it is given.

Toxic documents go, one document of each near-duplicate group stays, documents with benchmark passages go, the rest is
mixed to target weights, and the mix is encoded as a binary corpus. Each stage's result is written as Parquet in the
shared folder and read by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockloom.llm import decontaminate, mixing, shingles, tokenfile, toxicity
from blockloom.llm.common import table
from blockloom.llm.queries import TOKENIZER
from blockloom.session import materialize

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*DOCUMENT_COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.not_toxic(_documents(docs), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.one_of_each(_documents(docs))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(_documents(docs), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(_documents(docs))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenfile.token_table(_documents(docs), TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks), ("mixing", mix_sources), ("token_ids", write_tokens),
]

#: The fitted scores, hashes and tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
