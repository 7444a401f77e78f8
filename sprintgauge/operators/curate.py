"""Curation: filters, derived text, deduplication and the common cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import lexicon
from ..functions.html import html_to_text
from ..functions.language import detect_language
from ..functions.text import as_text, clean_ascii, is_nonblank, lemmas, strip_tags
from .ranking import ordered_rank

CURATED_COLUMNS = ["dataset_name", "row_ord", "issuekey", "description", "storypoint"]


def exclude_datasets(df: DataFrame, literals: list[str] = (lexicon.EXCLUDED_PROJECT,)) -> DataFrame:
    for literal in literals:
        df = df.filter(~F.col("dataset_name").contains(literal))
    return df


def filter_valid_points(df: DataFrame) -> DataFrame:
    return df.filter(F.col("storypoint") > 0)


def filter_cap(df: DataFrame, cap: float = lexicon.POINT_CAP) -> DataFrame:
    return df.filter(F.col("storypoint") <= cap)


def filter_nonblank(df: DataFrame) -> DataFrame:
    return df.filter(is_nonblank(F.col("description")))


def filter_language(df: DataFrame, language: str = "en") -> DataFrame:
    """Rows detected as ``language``.

    The label comes out of a generator, which the optimizer does not push
    filters through: detection stays after a repartition and the cheap filters.
    """
    label = F.explode(F.array(detect_language(F.col("description")))).alias("_language")
    return df.select("*", label).filter(F.col("_language") == language).drop("_language")


def filter_iqr(df: DataFrame, width: float = 1.5) -> DataFrame:
    """Drop points outside the quartile fences of their project (optional step).

    ``percentile`` keeps a value-to-count map, so partial aggregation collapses
    a hot project to its few distinct point values before the shuffle.
    """
    fences = df.groupBy("dataset_name").agg(
        F.percentile("storypoint", F.array(F.lit(0.25), F.lit(0.75))).alias("_q")
    ).select(
        "dataset_name",
        (F.col("_q")[0] - width * (F.col("_q")[1] - F.col("_q")[0])).alias("_low"),
        (F.col("_q")[1] + width * (F.col("_q")[1] - F.col("_q")[0])).alias("_high"),
    )
    return (
        df.join(F.broadcast(fences), "dataset_name")  # one row per project
        .filter(F.col("storypoint").between(F.col("_low"), F.col("_high")))
        .drop("_low", "_high")
    )


def concat_title(df: DataFrame, null_title: str = "nan") -> DataFrame:
    """``description`` becomes title, blank, description."""
    return df.withColumn(
        "description",
        F.concat(F.coalesce("title", F.lit(null_title)), F.lit(" "), F.col("description")),
    )


def dedup_first(df: DataFrame, order: str = "row_ord") -> DataFrame:
    """First row per project and text.

    Texts are compared by SHA-256, so the aggregate is a hash aggregate over short
    keys: copies collapse before the shuffle, and texts travel once, to the semi-join.
    """
    first = df.groupBy("dataset_name", F.sha2("description", 256).alias("_text")).agg(F.min(order).alias("_first"))
    first = first.select(F.col("dataset_name").alias("_project"), "_first")
    return df.join(first, F.col("dataset_name").eqNullSafe(F.col("_project")) & (F.col(order) == F.col("_first")), "left_semi")


def limit_per_dataset(df: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` rows per project in file order."""
    ranked = ordered_rank(df, ["dataset_name"], "row_ord", first=limit)
    return ranked.drop("rank", "group_size")


def common_cap(df: DataFrame) -> DataFrame:
    """One row: the smallest of the projects' largest points."""
    return (
        df.groupBy("dataset_name").agg(F.max("storypoint").alias("top"))
        .agg(F.min("top").alias("cap"))
    )


def uniform_cap(df: DataFrame) -> DataFrame:
    """Drop rows above the common cap, a scalar subquery over the same rows."""
    return df.filter(F.col("storypoint") <= common_cap(df).scalar())


def curate(raw: DataFrame, limit: int | None = None, cap: float = lexicon.POINT_CAP,
           null_title: str = "nan", detect: bool = True) -> DataFrame:
    """Filters to first copies. Cheap predicates come first, detection last.

    ``detect=False`` trusts a ``lang`` column instead of detecting.
    """
    kept = filter_nonblank(filter_cap(filter_valid_points(exclude_datasets(raw)), cap))
    kept = filter_language(kept) if detect else kept.filter(F.col("lang") == "en")
    rows = dedup_first(concat_title(kept, null_title).select(*CURATED_COLUMNS))
    return rows if limit is None else limit_per_dataset(rows, limit)


def treat(df: DataFrame, view: str = "both", native: bool = False) -> DataFrame:
    """Add the treated columns; cleaning and HTML removal run once for both.

    ``native=True`` drops tags by pattern and leaves entities as they are.
    """
    plain = clean_ascii(as_text(F.col("description")))
    # The cleaned text is a column of its own: the next step looks at it three times.
    with_text = df.withColumn("_cleaned", plain)
    cleaned = F.col("_cleaned")
    with_text = with_text.withColumn(
        "treated_description_bert", strip_tags(cleaned) if native else html_to_text(cleaned)).drop("_cleaned")
    if view == "bert":
        return with_text.withColumnRenamed("treated_description_bert", "treated_description")
    with_both = with_text.withColumn(
        "treated_description_ml", lemmas(F.col("treated_description_bert"))
    )
    if view == "ml":
        return with_both.drop("treated_description_bert").withColumnRenamed(
            "treated_description_ml", "treated_description"
        )
    return with_both
