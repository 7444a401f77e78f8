"""Predictions of simple rules, metric tables and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import metrics as m


def rule_predictions(role_rows: DataFrame, split: list[str], row: list[str]) -> DataFrame:
    """Mean and median of the train points as predictions for the test rows.

    Train points are first counted per distinct value, so both rules work on a
    handful of rows per split whatever the project's size.
    """
    histogram = (
        role_rows.filter(F.col("role") == "train")
        .groupBy(*split, "storypoint").agg(F.count(F.lit(1)).alias("n"))
    )
    rules = histogram.groupBy(*split).agg(
        (F.sum(F.col("storypoint") * F.col("n")) / F.sum("n")).alias("train_mean"),
        F.percentile("storypoint", 0.5, F.col("n")).alias("train_median"),
    )
    tested = role_rows.filter(F.col("role") == "test").join(F.broadcast(rules), split)  # one row per split
    return tested.select(
        *split, *row, F.col("storypoint").alias("y"),
        F.explode(F.create_map(
            F.lit("train_mean"), F.col("train_mean"),
            F.lit("train_median"), F.col("train_median"),
        )).alias("model", "prediction"),
    )


def score(predictions: DataFrame, keys: list[str], names: list[str] = ("mae", "r2", "rmse", "pearson"),
          digits: int | None = None) -> DataFrame:
    """All metrics of each group in one aggregation over ``y, prediction``."""
    y, p = F.col("y"), F.col("prediction")
    makers = {"mae": m.mae, "r2": m.r2, "rmse": m.rmse, "pearson": m.pearson, "mse": m.mse}
    columns = []
    for name in names:
        value = makers[name](y, p)
        columns.append((value if digits is None else F.round(value, digits)).alias(name))
    return predictions.groupBy(*keys).agg(*columns)


def fold_summary(predictions: DataFrame, keys: list[str], fold: str, digits: int = 6) -> DataFrame:
    """Mean and population deviation of each metric over the folds."""
    per_fold = score(predictions, [*keys, fold])
    columns = []
    for name in ("mae", "r2", "rmse", "pearson"):
        columns.append(F.round(F.avg(name), digits).alias(f"{name}_mean"))
        columns.append(F.round(F.stddev_pop(name), digits).alias(f"{name}_std"))
    return per_fold.groupBy(*keys).agg(*columns)


def valid_predictions(answers: DataFrame) -> DataFrame:
    """Rows where both the answer and the truth are numbers."""
    return answers.dropna(subset=["predicted", "actual"])


def best_trial(trials: DataFrame, keys: list[str]) -> DataFrame:
    """The trial with the least validation error; ties go to the lower number."""
    best = F.min(F.struct("mae", "trial", "params"))
    return trials.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.trial", "_b.params", "_b.mae")
