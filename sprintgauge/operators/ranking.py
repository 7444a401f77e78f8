"""Ranks and top-k inside groups without handing a whole group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon

# 4 hex digits: enough buckets to keep a group of 10^11 rows at about 10^6 each.
_BUCKET_DIGITS = 4
# Row numbers are unique, so a bucket of this width never holds more rows.
_ORDER_BITS = 16
_SALTS = 64


def seeded_hash(keys: list[str], seed: int = lexicon.SEED, purpose: str = "") -> Column:
    """md5 over seed, purpose and keys: a shuffle order any engine can repeat."""
    parts = [F.lit(f"{purpose}{seed}"), *[F.col(k).cast("string") for k in keys]]
    return F.md5(F.concat_ws(":", *parts))


def _ranked(df: DataFrame, group: list[str], bucket: Column, order: list[Column],
            first: int | None = None) -> DataFrame:
    """Adds ``rank`` (from 1) and ``group_size``.

    Buckets follow the sort order. Their sizes, one short row per bucket, give
    each bucket its starting offset; rows are then numbered inside their bucket
    only. The count is combined map-side, so the hot group costs no more than
    its even share. ``first`` keeps that many rows per group; buckets past it
    drop out at the join, before their rows are sorted.
    """
    keyed = df.withColumn("_bucket", bucket)
    upto = Window.partitionBy(*group).orderBy("_bucket")
    offsets = (
        keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *group, "_bucket",
            (F.sum("_n").over(upto) - F.col("_n")).alias("_offset"),
            F.sum("_n").over(Window.partitionBy(*group)).alias("group_size"),
        )
    )
    if first is not None:
        offsets = offsets.filter(F.col("_offset") < first)
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    ranked = (
        keyed.join(offsets, [*group, "_bucket"])
        .withColumn("rank", F.col("_offset") + F.row_number().over(inside))
        .drop("_bucket", "_offset")
    )
    return ranked if first is None else ranked.filter(F.col("rank") <= first)


def seeded_rank(
    df: DataFrame, group: list[str], keys: list[str],
    seed: int = lexicon.SEED, purpose: str = "",
) -> DataFrame:
    """Rank in seeded random order; ``keys`` must identify a row in its group."""
    hashed = df.withColumn("_hash", seeded_hash(keys, seed, purpose))
    bucket = F.substring("_hash", 1, _BUCKET_DIGITS)
    return _ranked(hashed, group, bucket, [F.col("_hash")]).drop("_hash")


def ordered_rank(df: DataFrame, group: list[str], order: str, first: int | None = None) -> DataFrame:
    """Rank by an integer column that is unique inside its group."""
    return _ranked(df, group, F.shiftright(order, _ORDER_BITS), [F.col(order)], first)


def top_k(
    df: DataFrame, group: list[str], order: list[Column], k: int,
    rank: str = "rank", salt_by: list[str] | None = None,
) -> DataFrame:
    """The k first rows of each group with their rank.

    With ``salt_by`` a group is first cut to k rows per salt, so the last step
    sees at most 64 k rows of it. Without, use it for groups known to be small.
    """
    if salt_by:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(_SALTS)))
        local = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_local", F.row_number().over(local))
            .filter(F.col("_local") <= k).drop("_local", "_salt")
        )
    final = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= k)
