"""TF-IDF: relational weights per split, and sparse vectors for model fitting."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicon
from ..functions.text import tokenize
from .ranking import top_k

# Largest vocabulary table, over all splits, that is sent to every task.
BROADCAST_ROWS = 2_000_000
# Requirements whose exploded terms one task regroups.
TASK_ROWS = 2048


def _placed(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df`` by key in as many partitions as ``rows`` need.

    The number is given: adaptive execution sees bytes before terms are exploded, and
    would merge partitions until a task's terms outgrow its memory.
    """
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *keys)


def term_bags(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per requirement with ``bag``, its terms and their counts.

    Rows are placed by key before they are exploded. Both regroupings then find
    the rows where they need them: the texts move once and the tokens never.
    """
    placed = _placed(df.select(*keys, text), keys, df.count())
    exploded = placed.select(*keys, F.explode_outer(tokenize(F.col(text))).alias("term"))
    counts = exploded.groupBy(*keys, "term").agg(F.count("term").alias("tf"))
    entry = F.when(F.col("term").isNotNull(), F.struct("term", "tf"))
    return counts.groupBy(*keys).agg(F.collect_list(entry).alias("bag"))


def term_df(bags: DataFrame) -> DataFrame:
    """Corpus frequency and document frequency per term."""
    terms = bags.select(F.explode("bag").alias("_t")).select("_t.*")
    return terms.groupBy("term").agg(
        F.sum("tf").alias("frequency"), F.count(F.lit(1)).alias("df"))


def token_frequencies(df: DataFrame, tokens: Column) -> DataFrame:
    """``term, frequency, df`` straight from token arrays.

    Every occurrence counts for the frequency and every distinct term of a row
    for the document frequency. Both are summed map-side in one aggregation by
    term, without regrouping by row first.
    """
    def counted(terms: Column, frequency: int, documents: int) -> Column:
        return F.transform(terms, lambda term: F.struct(
            term.alias("term"), F.lit(frequency).alias("frequency"), F.lit(documents).alias("df")))

    both = F.concat(counted(tokens, 1, 0), counted(F.array_distinct(tokens), 0, 1))
    return df.select(F.explode(both).alias("_t")).select("_t.*").groupBy("term").agg(
        F.sum("frequency").alias("frequency"), F.sum("df").alias("df"))


def top_terms(frequencies: DataFrame, group: list[str] = (), size: int = lexicon.MAX_TERMS) -> DataFrame:
    """The ``size`` most frequent terms, ties by term, with their ``rank``.

    Salted by term, so a vocabulary of any size is cut down in parallel first.
    """
    order = [F.desc("frequency"), F.asc("term")]
    return top_k(frequencies, list(group), order, size, salt_by=["term"])


def tfidf_rows(bags: DataFrame, roles: DataFrame, split: list[str], row: list[str],
               size: int = lexicon.MAX_TERMS) -> DataFrame:
    """One row per split and requirement: sorted ``idx`` and unit-length ``val``.

    Vocabulary and document frequency come from train rows only. Bags meet the
    splits as whole rows and are exploded afterwards. A row without any
    vocabulary term gets empty arrays.
    """
    keys = [*split, *[c for c in row if c not in split]]
    shared = [c for c in keys if c in bags.columns]
    n_bags = bags.count()
    in_splits = _placed(roles.select(*keys, "role"), shared, n_bags).join(_placed(bags, shared, n_bags), shared)
    train = (
        in_splits.filter(F.col("role") == "train")
        .select(*split, F.explode("bag").alias("_t")).select(*split, "_t.*")
        .groupBy(*split, "term")
        .agg(F.sum("tf").alias("frequency"), F.count(F.lit(1)).alias("df"))
    )
    documents = (
        roles.filter(F.col("role") == "train").groupBy(*split)
        .agg(F.count(F.lit(1)).alias("n_train"))
    )
    idf = top_terms(train, split, size).join(documents, split).select(
        *split, "term", (F.col("rank") - 1).alias("term_id"),
        (F.log((1 + F.col("n_train")) / (1 + F.col("df"))) + 1).alias("idf"),
    )
    if roles.select(*split).distinct().count() * size <= BROADCAST_ROWS:
        # At most ``size`` terms per split: small enough to send to every task,
        # and the exploded terms then stay with their row for the regrouping.
        idf = F.broadcast(idf)
    exploded = in_splits.select(*keys, "role", F.explode_outer("bag").alias("_t"))
    weighted = exploded.select(*keys, "role", "_t.*").join(idf, [*split, "term"], "left")
    weight = F.col("tf") * F.col("idf")
    entry = F.when(F.col("term_id").isNotNull(), F.struct("term_id", weight.alias("w")))
    gathered = weighted.groupBy(*keys, "role").agg(
        F.sort_array(F.collect_list(entry)).alias("_e"),
        F.sqrt(F.sum(weight * weight)).alias("_norm"),
    )
    return gathered.select(
        *keys, "role",
        F.transform("_e", lambda e: e["term_id"]).alias("idx"),
        F.transform("_e", lambda e: e["w"] / F.col("_norm")).alias("val"),
    )


def corpus_tfidf(bags: DataFrame, row: list[str]) -> DataFrame:
    """One row per bag: sorted ``idx`` and unit-length ``val`` over every term.

    No vocabulary is drawn up: ``idx`` is the 64-bit hash of a term, so rare terms
    count too and no list of terms is capped or broadcast. A row without terms gets
    empty arrays.
    """
    documents = bags.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = term_df(bags).select(
        "term", (F.log((1 + documents) / (1 + F.col("df"))) + 1).alias("idf"))
    terms = bags.select(*row, F.explode_outer("bag").alias("_t")).select(*row, "_t.*")
    weight = F.col("tf") * F.col("idf")
    entry = F.when(F.col("idf").isNotNull(), F.struct(
        F.xxhash64("term").alias("term_id"), weight.alias("w")))
    gathered = terms.join(idf, "term", "left").groupBy(*row).agg(
        F.sort_array(F.collect_list(entry)).alias("_e"),
        F.sqrt(F.sum(weight * weight)).alias("_norm"))
    return gathered.select(
        *row, F.transform("_e", lambda e: e["term_id"]).alias("idx"),
        F.transform("_e", lambda e: e["w"] / F.col("_norm")).alias("val"))


def fit_vectorizer(train: DataFrame, tokens: str = "tokens", output: str = "features",
                   size: int = lexicon.MAX_TERMS) -> PipelineModel:
    """Sparse TF-IDF vectors from one aggregation over the train rows.

    Only the vocabulary, at most ``size`` terms with their document frequency,
    reaches the driver. The transform runs row by row in the JVM.
    """
    frequencies = token_frequencies(train, F.col(tokens))
    vocabulary = top_terms(frequencies, (), size).orderBy("rank").collect()
    n = train.count()
    if not vocabulary:
        raise ValueError("no terms in the training rows")
    weights = [math.log((1 + n) / (1 + row["df"])) + 1 for row in vocabulary]
    counter = CountVectorizerModel.from_vocabulary(
        [row["term"] for row in vocabulary], inputCol=tokens, outputCol="_tf"
    )
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense(weights), inputCol="_tf", outputCol="_tfidf"
    )
    unit = Normalizer(p=2.0, inputCol="_tfidf", outputCol=output)
    return PipelineModel([counter, scale, unit])


def vectorize(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("_tf", "_tfidf")
