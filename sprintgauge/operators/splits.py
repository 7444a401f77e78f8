"""Folds, holdouts, cross-project cycles and the experiment grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicon
from .ranking import seeded_hash, seeded_rank

ROW = ["issuekey", "row_ord"]


def _fold_of(rank: Column, size: Column, k: int) -> Column:
    """Fold of a rank when the first ``size % k`` folds take one more row."""
    small = F.floor(size / k)
    extra = size % k
    in_large = extra * (small + 1)
    return F.when(
        rank <= in_large, F.floor((rank - 1) / (small + 1))
    ).otherwise(extra + F.floor(F.try_divide(rank - 1 - in_large, small))).cast("int") + 1


def kfold_assign(df: DataFrame, k: int = lexicon.FOLDS, seed: int = lexicon.SEED,
                 mode: str = "even") -> DataFrame:
    """``dataset_name, issuekey, row_ord, fold`` with folds from 1.

    ``even`` gives the exact sizes of a k-fold split; ``hash`` takes the fold
    from the row's hash alone, without any shuffle and with sizes equal only in
    expectation. Fewer rows than folds is an error.
    """
    rows = df.select("dataset_name", *ROW)
    if mode == "hash":
        number = F.conv(F.substring(seeded_hash(ROW, seed), 1, 8), 16, 10).cast("bigint")
        return rows.withColumn("fold", (number % k).cast("int") + 1)
    ranked = seeded_rank(rows, ["dataset_name"], ROW, seed)
    too_small = F.raise_error(
        F.concat(F.lit("fewer rows than folds in "), F.col("dataset_name"))
    ).cast("int")
    fold = F.when(F.col("group_size") < k, too_small).otherwise(
        _fold_of(F.col("rank"), F.col("group_size"), k)
    )
    return ranked.select("dataset_name", *ROW, fold.alias("fold"))


def holdout_split(df: DataFrame, fraction: float = lexicon.ML_HOLDOUT,
                  group: list[str] = ("dataset_name",), seed: int = lexicon.SEED) -> DataFrame:
    """Adds ``part``: ``holdout`` for ceil(n * fraction) rows per group, else ``train``."""
    ranked = seeded_rank(df, list(group), ROW, seed, purpose="holdout")
    limit = F.ceil(F.col("group_size") * F.lit(float(fraction)))
    part = F.when(F.col("rank") <= limit, "holdout").otherwise("train")
    return ranked.withColumn("part", part).drop("rank", "group_size")


def fold_join(rows: DataFrame, folds: DataFrame) -> DataFrame:
    return rows.join(folds, ["dataset_name", *ROW])


def intra_roles(folds: DataFrame, k: int = lexicon.FOLDS,
                fraction: float = lexicon.ML_HOLDOUT, seed: int = lexicon.SEED) -> DataFrame:
    """Each row in each of its project's k splits: train, validation or test."""
    spread = folds.withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(k)))).select(
        "dataset_name", "split", *ROW, (F.col("fold") == F.col("split")).alias("_test")
    )
    ranked = seeded_rank(spread, ["dataset_name", "split", "_test"], ROW, seed, "holdout")
    limit = F.ceil(F.col("group_size") * F.lit(float(fraction)))
    role = (
        F.when(F.col("_test"), "test")
        .when(F.col("rank") <= limit, "validation").otherwise("train")
    )
    return ranked.select("dataset_name", "split", *ROW, role.alias("role"))


def _cycles(df: DataFrame, at_least: int) -> DataFrame:
    """One row per cycle and project with its offset from the cycle's start.

    Only the set of project names is gathered, and it is combined map-side.
    """
    names = df.agg(F.array_sort(F.collect_set("dataset_name")).alias("names"))
    checked = names.withColumn("n", F.when(
        F.size("names") < at_least,
        F.raise_error(F.lit(f"needs at least {at_least} projects")).cast("int"),
    ).otherwise(F.size("names")))
    cycles = checked.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return cycles.select(
        "cycle", "n", F.posexplode("names").alias("position", "dataset_name")
    ).withColumn("offset", F.pmod(F.col("position") - F.col("cycle"), F.col("n")))


def leave_one_out_roles(df: DataFrame) -> DataFrame:
    """Cycle i tests on project i, validates on the next, trains on the others."""
    role = (
        F.when(F.col("offset") == 0, "test")
        .when(F.col("offset") == 1, "validation").otherwise("train")
    )
    return _cycles(df, 3).select("cycle", "dataset_name", role.alias("role"))


def four_way_roles(df: DataFrame) -> DataFrame:
    """Cycle i trains on projects i and i+1, validates on i+2, tests on i+3."""
    role = (
        F.when(F.col("offset") <= 1, "train")
        .when(F.col("offset") == 2, "validation").otherwise("test")
    )
    return _cycles(df, 4).filter("offset <= 3").select(
        "cycle", "dataset_name", role.alias("role")
    )


def role_rows(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """Rows with the cycles they take part in.

    The role table has one row per cycle and project. It is left to adaptive
    execution to broadcast it, which also spares the hot project a shuffle.
    """
    return rows.join(roles, "dataset_name")


def train_label(roles: DataFrame, separator: str = "_") -> DataFrame:
    """Names of each cycle's training projects in one string, plus the other two."""
    def named(role: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col("dataset_name")))

    train = F.collect_list(F.when(F.col("role") == "train", F.col("dataset_name")))
    return roles.groupBy("cycle").agg(
        F.array_join(F.array_sort(train), separator).alias("train_set"),
        named("validation").alias("validation"), named("test").alias("test"),
    )


def split_sizes(roles: DataFrame, keys: list[str]) -> DataFrame:
    return roles.groupBy(*keys, "role").agg(F.count(F.lit(1)).alias("n_rows"))


def intra_grid(df: DataFrame, models: list[str], version: str, k: int | None = None) -> DataFrame:
    """Work list of the within-project scheme; one row per fold if ``k`` is given."""
    names = df.agg(F.collect_set("dataset_name").alias("names"))
    grid = names.select(
        F.lit(version).alias("version"), F.explode("names").alias("dataset_name")
    ).withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    if k is not None:
        grid = grid.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return grid


def inter_grid(labels: DataFrame, models: list[str], version: str) -> DataFrame:
    return labels.select(
        F.lit(version).alias("version"), "train_set", "validation", "test"
    ).withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


INTRA_KEY = ["version", "model", "dataset_name"]
INTER_KEY = ["version", "train_set", "validation", "test", "model"]


def pending(work: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Experiments the ledger does not hold yet."""
    return work.join(ledger.select(*keys), keys, "left_anti")
