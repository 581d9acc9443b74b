"""A corpus pipeline: rules, near duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as the
next stage's documents. All but the last return the columns of ``documents``. Nulls, empty texts, ties, repeated rows, empty
tables and further columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.llm import mixing, near_dedup, quality_rules, secret_scan, sentencepiece
from quillvec.llm.columns import plain
from quillvec.session import delete, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no adaptive quality rule."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and all that are in none."""
    return near_dedup.deduplicate(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in them replaced."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents within the token budget, interleaved by source weight."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token_ids; ``round_trip`` says that decoding restores the text."""
    out = sentencepiece.encode(plain(docs, ["doc_id", "lang", "source", "text"]).select("doc_id", "lang", "source", "text"), check="round_trip")
    return out.select("doc_id", "lang", "source", F.size("token_ids").alias("n_tokens"), "token_ids", "round_trip")


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("secret scan", secrets),
    ("source mixture", mixture),
    ("sentencepiece", tokens),
]

#: Hashing of near duplicates and the tokeniser aren't expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of ``sf_dir``; each result is a Parquet table in the shared folder.

    A stage's table is deleted once the next one is written; the last one, which the result reads, when the driver ends.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = scratch(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
