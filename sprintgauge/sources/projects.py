"""Scan of a folder of project CSV exports into one relation."""

from __future__ import annotations

import functools
from multiprocessing.pool import ThreadPool
from urllib.parse import unquote

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import lexicon
from ..functions.answers import to_number
from ..functions.text import strip

FIELDS = ["issuekey", "title", "description", "storypoint"]


def _not_missing(value: Column) -> Column:
    return F.when(~value.isin(lexicon.NA_STRINGS), value)


# A project is one file named after it, or a partition folder of part files.
_FOLDER = "dataset_name="


def project_of(path: str) -> str:
    """Name of the project an export file belongs to."""
    *_, folder, name = ["", *path.split("/")]
    return unquote(folder.removeprefix(_FOLDER)) if folder.startswith(_FOLDER) else name.removesuffix(".csv")


def _project_column() -> Column:
    """``project_of`` for the file a row is read from, whose path is escaped once more."""
    def decoded(text: Column) -> Column:
        return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))

    folder = F.regexp_extract("_metadata.file_path", f"/{_FOLDER}([^/]*)/[^/]*$", 1)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv\z", "")
    return F.when(folder == "", stem).otherwise(decoded(decoded(folder)))


def project_names(spark: SparkSession, root: str) -> set[str]:
    return {project_of(p) for p in project_files(spark, root)}


def project_files(spark: SparkSession, root: str, suffix: str = ".csv") -> list[str]:
    """Paths of the export files; the file index answers, contents stay unread."""
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{suffix}").load(root).select("path")
    )
    return sorted(row.path for row in listing.toLocalIterator())


def _one_file_each(spark: SparkSession, root: str) -> None:
    """Raise when two exports have one name: a project is one file or one folder of parts."""
    seen: dict[str, str] = {}
    for path in project_files(spark, root):
        folder = path.rsplit("/", 1)[0]
        export = folder if folder.rsplit("/", 1)[-1].startswith(_FOLDER) else path
        if seen.setdefault(project_of(path), export) != export:
            raise ValueError(f"several exports are named {project_of(path)}.csv: a project is one export")


def _numbered(rows: DataFrame) -> DataFrame:
    """``row_ord``: place of a row in its export, from 0, however files are cut and packed.

    A running id goes up inside each split of a file, wherever it starts. One count
    per split, the size of the file listing, says where the split begins. Part files
    of one export follow each other by path.
    """
    splits = rows.groupBy("dataset_name", "_file", "_block").agg(
        F.min("_running").alias("_start"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("dataset_name").orderBy("_file", "_block")
    splits = splits.select("_file", "_block", (F.sum("_n").over(before) - F.col("_n") - F.col("_start")).alias("_shift"))
    joined = rows.join(F.broadcast(splits), ["_file", "_block"])
    return joined.select("dataset_name", (F.col("_running") + F.col("_shift")).alias("row_ord"),
                         *[F.col(f"`{c}`") for c in rows.columns[4:]])


def _reader(spark: SparkSession, multi_line: bool):
    return (
        spark.read.option("header", True).option("multiLine", multi_line)
        .option("quote", '"').option("escape", '"').option("enforceSchema", False)
    )


def scan_columns(
    spark: SparkSession, root: str, required: list[str], optional: list[str] = (),
    multi_line: bool = True, excluded: list[str] = (), skip: set[str] = frozenset(),
) -> DataFrame:
    """Union of the files that have all ``required`` columns, read by header name.

    Projects in ``skip`` and those whose name contains an ``excluded`` literal
    are left out by file name, so they are never opened.

    Files sharing a header are read together, so the union has one branch per
    distinct layout and not one per file. Missing optional columns are NULL.
    ``multi_line=False`` lets Spark split a large export; use it when no quoted
    field holds a line break.
    """
    wanted_paths = []
    for path in project_files(spark, root):
        project = project_of(path)
        if project not in skip and not any(literal in project for literal in excluded):
            wanted_paths.append(path)
    layouts: dict[tuple[str, ...], list[str]] = {}
    with ThreadPool(16) as pool:
        headers = pool.map(inheritable_thread_target(
            lambda path: tuple(_reader(spark, multi_line).csv(path).columns)), wanted_paths)
    for path, header in zip(wanted_paths, headers):
        if set(required) <= set(header):
            layouts.setdefault(header, []).append(path)
    if not layouts:
        raise ValueError(f"no export under {root} has the columns {required}")
    branches = []
    for header, paths in sorted(layouts.items()):
        wanted = [c for c in [*required, *optional] if c in header]
        rows = _reader(spark, multi_line).csv(paths).select(
            _project_column().alias("dataset_name"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_running"),
            *[_not_missing(F.col(f"`{c}`")).alias(c) for c in wanted],
        )
        branches.append(_numbered(rows))
    merged = functools.reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), branches
    )
    absent = [c for c in optional if c not in merged.columns]
    return merged.withColumns({c: F.lit(None).cast("string") for c in absent})


def scan_requirements(
    spark: SparkSession, root: str, multi_line: bool = True,
    excluded: list[str] = (lexicon.EXCLUDED_PROJECT,), skip: set[str] = frozenset(),
) -> DataFrame:
    """Raw requirements of every project under ``root``, one file or folder of parts each."""
    _one_file_each(spark, root)
    rows = scan_columns(
        spark, root, ["description", "storypoint", "issuekey", "title"],
        multi_line=multi_line, excluded=excluded, skip=skip,
    )
    return rows.withColumn("storypoint", to_number(strip(F.col("storypoint")))).select(
        "dataset_name", "row_ord", *FIELDS
    )


def language_corpus(spark: SparkSession, root: str, column: str = "treated_description_bert") -> DataFrame:
    """``text`` of every treated export that has the treated column."""
    rows = scan_columns(spark, root, [column])
    return rows.select(F.col(column).alias("text"))


def retrieval_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Complete ``description, storypoint`` pairs of every export that has both."""
    rows = scan_columns(spark, root, ["description", "storypoint"])
    return rows.select("description", "storypoint").dropna()


def with_defaults(df: DataFrame) -> DataFrame:
    """Columns an evaluation file may lack; cells that are NULL stay NULL."""
    defaults = {"issuekey": F.lit(lexicon.MISSING_KEY), "storypoint": F.lit(None).cast("double")}
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})
