"""Regression metrics as aggregate columns.

All of them are algebraic: sums and moments that combine map-side, so one hot
group never lands whole on one task.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(mse(y, p))


def r2(y: Column, p: Column) -> Column:
    """1 - residual / total. A constant target scores 1 if met, else 0."""
    residual = F.sum((y - p) * (y - p))
    constant = F.min(y) == F.max(y)
    total = F.var_pop(y) * F.count(y)
    return (
        F.when(constant & (residual == 0), F.lit(1.0))
        .when(constant, F.lit(0.0))
        .otherwise(1 - F.try_divide(residual, total))
    )


def pearson(y: Column, p: Column) -> Column:
    """Correlation; NULL when either side is constant."""
    varies = (F.min(y) != F.max(y)) & (F.min(p) != F.max(p))
    spread = F.stddev_pop(y) * F.stddev_pop(p)
    return F.when(varies, F.try_divide(F.covar_pop(y, p), spread))


def perplexity(loss: Column) -> Column:
    return F.exp(F.avg(loss))
