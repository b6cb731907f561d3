"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import (
    decontaminate,
    exact_dedup,
    language,
    near_dup,
    negatives,
    order_minhash,
    phrases,
    pieces,
    sharding,
    token_counts,
    token_files,
    toxicity,
    url_filter,
)
from tidemark.llm.common import in_bucket, table
from tidemark.session import scratch_dir

SHARDS = 40
TOKEN_LIMIT = 4096
OP7_NEAR = 85  # per cent, the contract of op7 alone
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.decisions(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.assign(sharding.keyed(table(spark, sf_dir, "documents")), SHARDS)
    grown = F.lit(None).cast("int").alias("grown_shard")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", grown)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encoded(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    digits = F.concat_ws(",", F.col("ids").cast("array<string>"))
    sizes = F.size("ids").cast("long").alias("n_tokens")
    return found.select("doc_id", sizes, F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.verdicts(table(spark, sf_dir, "pages"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), in_bucket("doc_id", 5, 0)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", "toxic"))
    found = toxicity.scored(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), in_bucket("doc_id", 4, 2)
    model = language.fit(docs, ~held_out)
    return language.labelled(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"), near=OP7_NEAR)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), scratch_dir(spark, "token-files")
    token_files.write_token_files(docs, path, vocabulary("byte_bpe_50k.json"))
    return token_files.checksums(token_files.read_token_files(spark, path, docs.schema["doc_id"].dataType.simpleString()))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.counted(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    noisy = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(noisy, F.col("vec_id") % 100 == 0)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.fingerprints(table(spark, sf_dir, "documents"))
    return found.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_exact_dedup, op2_sharding, op3_sentencepiece, op4_url_filter, op5_toxicity, op6_language_id, op7_near_dup, op8_token_files, op9_token_counts]
    named += [op10_decontamination, op11_hard_negatives, op12_fingerprints, op13_collocations]
    return {f.__name__: f for f in named}
