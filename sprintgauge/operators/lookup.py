"""Neighbour-based regressors: averages over the rows a join has found."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def average_of_neighbours(labelled: DataFrame, keys: list[str], ks: list[int]) -> DataFrame:
    """One prediction per query and k: the mean target of the k nearest rows.

    ``labelled`` holds ``keys, rank, storypoint``. All values of k come from
    the same neighbour table.
    """
    means = [F.avg(F.when(F.col("rank") <= k, F.col("storypoint"))) for k in ks]
    pairs = [part for k, mean in zip(ks, means) for part in (F.lit(f"knn{k}"), mean)]
    return labelled.groupBy(*keys).agg(F.create_map(*pairs).alias("_m")).select(
        *keys, F.explode("_m").alias("model", "prediction")
    )


def select_and_weigh(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Weight of each base model per query from its error near the query.

    Models no worse than the mean local error are kept and weighted by inverse
    error. ``errors`` holds ``keys, model, local_error``: a few rows per query,
    so they are gathered in one array and no window is needed.
    """
    gathered = errors.groupBy(*keys).agg(
        F.collect_list(F.struct("model", "local_error")).alias("_e"),
        F.avg("local_error").alias("_mean"),
    )
    kept = F.filter("_e", lambda e: e["local_error"] <= F.col("_mean") + 1e-12)
    return gathered.select(*keys, F.explode(kept).alias("_k")).select(
        *keys, "_k.model", (1 / (F.col("_k.local_error") + 1e-6)).alias("weight")
    )


def dynamic_ensemble(predictions: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    joined = predictions.join(weights, [*keys, "model"])
    total = F.sum(F.col("prediction") * F.col("weight")) / F.sum("weight")
    return joined.groupBy(*keys).agg(total.alias("prediction"))
