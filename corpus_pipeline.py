"""A training corpus from raw documents: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet below the shared folder and rereads it as
the next one's docs. All but the last return the columns of docs; the last returns one row per document that is left.

The stages judge rows, never ids alone: rows with a null text have no language and go in the first stage; of repeated rows one stays; an
empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontaminate, exact_dedup, language, near_dup, pieces
from tidemark.llm.common import in_bucket, stored, table
from tidemark.llm.queries import vocabulary


#: Per cent of five-word shingles in common from which documents are near copies; 85 is the contract of op7 alone.
NEAR = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or without one that holds a fair part of their letters, go."""
    model = language.fit(docs, ~in_bucket("doc_id", 4, 2))
    return language.keep_identified(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that differ in white space only, the longest stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five words, 0.8 or more) stays."""
    return near_dup.drop_near_copies(docs, near=NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold enough of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    found = pieces.encoded(docs, vocabulary("piece_bpe_32k.model"))
    digits = F.concat_ws(",", F.col("ids").cast("array<string>"))
    sizes = F.size("ids").cast("long").alias("n_tokens")
    return found.select("doc_id", sizes, F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: The language model and the tokenizer are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
