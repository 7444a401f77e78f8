"""Shared starting points of the registered queries."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import curate as ops
from ..session import stage
from ..sources.tables import requirements

_STAGED: dict[tuple[str, str, str], DataFrame] = {}
_LOCK = threading.RLock()


def staged_once(spark: SparkSession, sf_dir: str, name: str, build, partition_by=None) -> DataFrame:
    """Build a derived table once per session and input, then read it.

    Later plans scan the staged Parquet, so their filters and column lists
    reach it, and none of them repeats language detection.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    with _LOCK:
        if key not in _STAGED:
            _STAGED[key] = stage(build(), name, partition_by)
        return _STAGED[key]


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements after the cheap predicates."""
    raw = ops.exclude_datasets(requirements(spark, sf_dir))
    return ops.filter_nonblank(ops.filter_cap(ops.filter_valid_points(raw)))


def first_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated rows before the common cap, from scratch."""
    rows = ops.filter_language(candidates(spark, sf_dir))
    return ops.dedup_first(ops.concat_title(rows).select(*ops.CURATED_COLUMNS))


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated, treated and capped rows, staged per session.

    The cap needs a pass over the deduplicated rows, so those are staged first.
    """
    deduplicated = staged_once(
        spark, sf_dir, "first_copies", lambda: first_copies(spark, sf_dir)
    )
    return staged_once(
        spark, sf_dir, "curated",
        lambda: ops.treat(ops.uniform_cap(deduplicated)), ["dataset_name"],
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated rows with ``text``, the column models read."""
    return curated(spark, sf_dir).withColumn("text", F.col("treated_description_ml"))
