"""The given Parquet tables, and requirements derived from ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw requirements: one row per document, one project per ``dataset_name``.

    Columns: ``dataset_name, row_ord, issuekey, title, description, storypoint``
    and ``lang``, the label the documents carry.
    """
    doc, size = F.col("doc_id"), F.col("n_chars")

    def ladder(*steps: tuple[int, int], last: int):
        points = F.lit(None)
        for limit, value in reversed(steps):
            tail = F.lit(float(last)) if (limit, value) == steps[-1] else points
            points = F.when(size < limit, float(value)).otherwise(tail)
        return points

    short_scale = ladder((1000, 1), (2000, 3), last=5)
    full_scale = ladder((400, 1), (900, 2), (1500, 3), (3000, 5), (6000, 8), last=13)
    return table(spark, sf_dir, "documents").select(
        F.when(F.col("source") == "src19", "titanium")
        .otherwise(F.concat(F.lit("ds"), (doc % 5).cast("string")))
        .alias("dataset_name"),
        doc.alias("row_ord"),
        F.concat(F.lit("REQ-"), doc.cast("string")).alias("issuekey"),
        F.when(size % 29 != 0, F.concat(F.lit("Item "), (size % 97).cast("string")))
        .alias("title"),
        F.when(doc % 31 == 0, None).when(doc % 37 == 0, "   ")
        .otherwise(F.col("text")).alias("description"),
        F.when(doc % 41 == 0, None).when(doc % 43 == 0, 0.0)
        .when(doc % 5 == 3, short_scale).otherwise(full_scale)
        .cast("double").alias("storypoint"),
        "lang",
    )

