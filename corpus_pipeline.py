"""From raw documents to token counts: rules, near duplicates, decontamination, PII, BPE.

Each stage takes the documents its predecessor kept and is written as Parquet before
the next one reads them. Every stage but the last returns the columns of documents,
extra ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sprintgauge.llm import bpe, decontaminate, jaccard_join, pii, quality_rules
from sprintgauge.llm.queries import PII_KEY, tokenizer_path
from sprintgauge.session import ship_package, stage
from sprintgauge.sources.tables import table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality_rules.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least id, of each group linked by 5-word shingles at 0.8."""
    ship_package(spark)
    return jaccard_join.keep_one(docs, jaccard_join.Likeness(width=5, percent=80))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found; rows with a null id stay."""
    ship_package(spark)
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return jaccard_join.without(docs, found.filter("doc_id IS NOT NULL").select("doc_id").distinct())


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms of the same format; ``n_chars`` follows."""
    out = pii.pseudonymise(docs, PII_KEY, count_col=None)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each document that is left."""
    ship_package(spark)
    return bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", rules),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminated),
    ("pii", pseudonymised),
    ("bpe", encoded),
]

#: SQL has no BPE, no Feistel permutation and no bit-parallel matching.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
