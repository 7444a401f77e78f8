"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_STEPS = 1 << 20


def bounded(rows: DataFrame, bound: int, by: list[str]) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of ``by``: all when there are fewer.

    Rows that are equal in ``by`` count once, so a repeated row cannot fill the sample. The
    share is the bound over their number, so no task sorts or holds them all.
    """
    total = rows.select(*by).distinct().count()
    share = min(_STEPS, int(_STEPS * bound / max(total, 1)))
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), *by), F.lit(_STEPS)) < share).dropDuplicates(by)
