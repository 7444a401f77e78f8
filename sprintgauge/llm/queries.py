"""The registered query of each operation, over whole tables and with production settings."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import staging_root
from ..sources.tables import table
from . import (bpe, chat, decontaminate, jaccard_join, katz, pii, quality_model, quality_rules,
               spelling, substring_dedup, token_store, toxicity, whitening)

#: The key of registered runs; a user passes a secret one.
PII_KEY = "registered-query"
#: Contract of the n-gram join query: 3-word windows, 90 in 100.
NGRAMS = jaccard_join.Likeness(width=3, percent=90)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fold(parts: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def _labels(spark: SparkSession, sf_dir: str, column: str, parts: int, held: int) -> DataFrame:
    return table(spark, sf_dir, "labels").filter(_fold(parts) != held).select(
        "doc_id", F.col(column).alias("label"))


def quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def quality_model_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_model.learn_and_score(
        table(spark, sf_dir, "documents"), _labels(spark, sf_dir, "quality", 4, 2))
    return scored.select("doc_id", (_fold(4) == 2).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


def decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def token_store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{staging_root(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"))
    return token_store.checksums(token_store.read(spark, folder))


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = toxicity.fit(docs, _labels(spark, sf_dir, "toxic", 5, 0))
    return toxicity.score(docs, weights).select(
        "doc_id", (_fold(5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def substring_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def jaccard_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"), NGRAMS)


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY)


def katz_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = katz.learn_and_score(table(spark, sf_dir, "documents"), _fold(5) != 1)
    return scored.select("doc_id", (_fold(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def whitening_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def spelling_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.groups(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": quality_rules_query,
    "op2_quality_classifier": quality_model_query,
    "op3_decontamination": decontaminate_query,
    "op4_token_store": token_store_query,
    "op5_toxicity": toxicity_query,
    "op6_substring_dedup": substring_dedup_query,
    "op7_jaccard_join": jaccard_join_query,
    "op8_bpe": bpe_query,
    "op9_chat_perspectives": chat_query,
    "op10_pii": pii_query,
    "op11_katz_scores": katz_query,
    "op12_whitening": whitening_query,
    "op13_spelling_variants": spelling_query,
}
