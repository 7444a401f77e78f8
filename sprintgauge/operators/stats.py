"""Descriptive statistics per project."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import lexicon
from ..functions.text import word_count


def dataset_stats(df: DataFrame) -> DataFrame:
    """Rows, words per row and points per project; deviations are population ones."""
    points = F.col("storypoint")
    return (
        df.select("dataset_name", "storypoint", word_count(F.col("description")).alias("words"))
        .groupBy("dataset_name")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.round(F.avg("words"), 6).alias("words_mean"),
            F.round(F.stddev_pop("words"), 6).alias("words_std"),
            F.min(points).alias("point_min"),
            F.max(points).alias("point_max"),
            F.round(F.avg(points), 6).alias("point_mean"),
            F.percentile(points, 0.5).alias("point_median"),
        )
    )


def point_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset_name", "storypoint").agg(F.count(F.lit(1)).alias("n_rows"))


def fibonacci_distribution(df: DataFrame) -> DataFrame:
    return point_distribution(
        df.filter(F.col("storypoint").isin([float(v) for v in lexicon.FIBONACCI]))
    )
