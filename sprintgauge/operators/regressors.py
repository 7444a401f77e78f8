"""MLlib regressors behind TF-IDF vectors, with the study's settings."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor,
)
from pyspark.sql import DataFrame, functions as F

from ..functions import lexicon

# Settings of the study's regressors.
RIDGE_ALPHA = 1.0
SPARSE_ALPHA = 0.1
L1_RATIO = 0.5
TREE_DEPTH = 10
FOREST_DEPTH = 30  # the study sets none; MLlib allows no more
TREES = 100
DEEP = {"maxDepth": 6, "stepSize": 0.3}
SHALLOW = {"maxDepth": 5, "stepSize": 0.1}
TRIALS = 5

LABEL, FEATURES = "storypoint", "features"
_COMMON = {"labelCol": LABEL, "featuresCol": FEATURES}
# Counts of the nodes that a task fills at once, in MB; four tasks share an executor. It has no say in the trees.
_TREE = {**_COMMON, "seed": lexicon.SEED, "maxMemoryInMB": 256}


def target_stats(train: DataFrame) -> tuple[int, float]:
    """Rows and sample deviation of the target, in one aggregation."""
    row = train.agg(F.count(LABEL).alias("n"), F.stddev_samp(LABEL).alias("s")).first()
    return row["n"], row["s"] or 1.0


def linear(**options) -> LinearRegression:
    return LinearRegression(
        **{**_COMMON, "solver": "l-bfgs", "standardization": False, "maxIter": 300,
           "tol": 1e-7, **options})


def make(name: str, n: int, deviation: float, trees: int = TREES, **options) -> Estimator:
    """Estimator by model name.

    MLlib fits on a target divided by its deviation, so quadratic penalties
    are scaled with it to mean what the study's penalties mean.
    """
    if name == "linear":
        return linear(regParam=0.0, maxIter=100, tol=1e-6)
    if name == "ridge":
        return linear(elasticNetParam=0.0, regParam=RIDGE_ALPHA * deviation / n)
    if name == "lasso":
        return linear(elasticNetParam=1.0, regParam=SPARSE_ALPHA)
    if name == "elastic_net":
        total = SPARSE_ALPHA * (L1_RATIO + deviation * (1 - L1_RATIO))
        return linear(elasticNetParam=SPARSE_ALPHA * L1_RATIO / total, regParam=total)
    if name == "tree":
        return DecisionTreeRegressor(**_TREE, maxDepth=TREE_DEPTH)
    if name == "forest":
        settings = {"maxDepth": FOREST_DEPTH, "numTrees": trees, **options}
        return RandomForestRegressor(**_TREE, featureSubsetStrategy="all", **settings)
    if name == "boosted_deep":
        return GBTRegressor(**_TREE, **{"maxIter": trees, **DEEP, **options})
    if name == "boosted_shallow":
        return GBTRegressor(**_TREE, **{"maxIter": trees, **SHALLOW, **options})
    raise ValueError(f"no model named {name}")


def fit(name: str, train: DataFrame, **options) -> Transformer:
    n, deviation = target_stats(train)
    return make(name, n, deviation, **options).fit(train)


def predict(model: Transformer, rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
    return model.transform(rows).select(
        *keys, F.col(LABEL).alias("y"), F.lit(name).alias("model"), "prediction")


class FourierFeatures(Transformer, HasInputCol, HasOutputCol):
    """Random Fourier features of a Gaussian kernel (Rahimi and Recht, 2007).

    An approximation of kernel regression that stays linear in the rows. The
    projection is drawn from the seed in each worker and never shipped.
    """

    def __init__(self, width: int, components: int, gamma: float, inputCol: str = FEATURES,
                 outputCol: str = "fourier", seed: int = lexicon.SEED):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)
        self.shape, self.gamma, self.seed = (width, components), gamma, seed

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shape, gamma, seed = self.shape, self.gamma, self.seed

        @F.pandas_udf("array<double>")
        def project(indices: pd.Series, values: pd.Series) -> pd.Series:
            draw = np.random.default_rng(seed)
            weights = draw.normal(0.0, np.sqrt(2.0 * gamma), size=shape)
            shift = draw.uniform(0.0, 2.0 * np.pi, size=shape[1])
            out = [np.sqrt(2.0 / shape[1]) * np.cos(v @ weights[i] + shift)
                   for i, v in zip(indices, values)]
            return pd.Series(out)

        raw = F.unwrap_udt(F.col(self.getInputCol()))
        return dataset.withColumn(
            self.getOutputCol(), array_to_vector(project(raw["indices"], raw["values"])))


def kernel_width(train: DataFrame, width: int) -> float:
    """1 / (width * variance of all matrix entries), the usual kernel scale."""
    values = F.unwrap_udt(F.col(FEATURES))["values"]
    plain = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    squares = F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v)
    row = train.agg(F.sum(plain).alias("s"), F.sum(squares).alias("q"),
                    F.count(F.lit(1)).alias("n")).first()
    cells = row["n"] * width
    variance = row["q"] / cells - (row["s"] / cells) ** 2
    return 1.0 / (width * variance) if variance > 0 else 1.0


def fit_fourier_huber(train: DataFrame, width: int, components: int = 256):
    """Kernel features and a robust linear fit, standing in for an SVR."""
    features = FourierFeatures(width, components, kernel_width(train, width))
    regressor = LinearRegression(
        labelCol=LABEL, featuresCol="fourier", loss="huber", regParam=1e-3, maxIter=200)
    model = regressor.fit(features.transform(train))
    return lambda rows: model.transform(features.transform(rows)).drop("fourier")


def in_parallel(jobs: list, run, threads: int = 4) -> list:
    """Independent fits submitted together; Spark shares its slots among them."""
    with ThreadPool(min(threads, max(len(jobs), 1))) as pool:
        return pool.map(inheritable_thread_target(run), jobs)


BASES = ("ridge", "forest", "boosted_deep")


def _with_bases(models: dict, rows: DataFrame) -> DataFrame:
    for name, model in models.items():
        rows = model.setPredictionCol(f"base_{name}").transform(rows)
    return rows


def fit_stacking(train: DataFrame, fold: str = "fold", k: int = lexicon.FOLDS,
                 bases: tuple[str, ...] = BASES, stage=lambda df: df, **options):
    """Ridge over out-of-fold predictions of the base models.

    The final model never sees a base prediction on a row that base was fitted
    on. ``stage`` may materialise the out-of-fold rows.
    """
    def fit_bases(part: int | None):
        rows = train if part is None else train.filter(F.col(fold) != part)
        return part, {b: fit(b, rows, **options) for b in bases}

    fitted = dict(in_parallel([None, *range(1, k + 1)], fit_bases))
    held = [_with_bases(fitted[part], train.filter(F.col(fold) == part))
            for part in range(1, k + 1)]
    rows = held[0]
    for more in held[1:]:
        rows = rows.unionByName(more)
    assembler = VectorAssembler(inputCols=[f"base_{b}" for b in bases], outputCol="stacked")
    level_two = stage(assembler.transform(rows).select(LABEL, "stacked"))
    n, deviation = target_stats(level_two)
    final = make("ridge", n, deviation).setFeaturesCol("stacked").fit(level_two)
    return lambda new: final.transform(
        assembler.transform(_with_bases(fitted[None], new))
    ).drop("stacked", *[f"base_{b}" for b in bases])


def random_trials(name: str, count: int = TRIALS, seed: int = lexicon.SEED) -> list[dict]:
    """Seeded draws from the study's search ranges."""
    draw = np.random.default_rng(seed)
    trials = []
    for _ in range(count):
        trees = int(draw.integers(50, 201))
        if name == "forest":
            trials.append({"trees": trees, "maxDepth": int(draw.choice([10, 15, 20, 25, 30]))})
        else:
            rate = float(np.exp(draw.uniform(np.log(0.01), np.log(0.3))))
            trials.append({"trees": trees, "maxDepth": int(draw.integers(3, 11)),
                           "stepSize": rate})
    return trials


def tune(name: str, train: DataFrame, validation: DataFrame, trials: list[dict],
         threads: int = 2) -> list[tuple[int, str, float]]:
    """``(trial, settings, validation MAE)`` of each trial, fitted side by side.

    Trials are groups of one job where a task can hold the rows, else MLlib fits.
    """
    from . import group_models

    role = lambda rows, is_: rows.withColumns({"role": F.lit(is_), "split": F.lit(1)})
    rows = role(train, "train").unionByName(role(validation, "test"))
    numbered = list(enumerate(trials, 1))
    fits = group_models.predict if not group_models.oversized(rows, ["split"]) else \
        group_models.predict_sparse if name in group_models.SPARSE and group_models.within_entries(rows, ["split"]) else None
    if fits:
        jobs = [(str(number), name, repr(settings)) for number, settings in numbered]
        errors = fits(rows, ["split"], jobs).groupBy("model").agg(
            F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("mae")).collect()  # one row per trial
        found = {row.model: row.mae for row in errors}
        return [(number, str(settings), float(found[str(number)])) for number, settings in numbered]

    def run(job):
        number, settings = job
        scored = fit(name, train, **settings).transform(validation)
        error = scored.agg(F.avg(F.abs(F.col(LABEL) - F.col("prediction")))).first()[0]
        return number, str(settings), float(error)

    return in_parallel(numbered, run, threads)
