"""Registered queries: fitted models, tuning and the growing tables."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators import features, group_models, regressors as r, scoring, splits, stages
from ..session import stage, staging_root, use_checkpoints
from ..sources import sinks
from ..sources.tables import table
from . import base, ensemble, evaluation as ev, experiments, oracles as o

KEYS = ["dataset_name", "issuekey", "row_ord"]
#: The families whose settings the study searches.
TUNED = ("forest", "boosted_deep", "boosted_shallow")


def _vectorizer(s, d):
    """Vectoriser fitted on the train part of a per-project holdout split."""
    key = (s.sparkContext.applicationId, d)
    if key not in _FITTED:
        _FITTED[key] = features.fit_vectorizer(_tokens(s, d).filter("part = 'train'"))
    return _FITTED[key]


_FITTED: dict = {}


def _tokens(s, d):
    def build():
        rows = splits.holdout_split(base.corpus(s, d).select(*KEYS, "storypoint", "text"))
        return rows.withColumn("tokens", tokenize(F.col("text"))).drop("text")
    return base.staged_once(s, d, "tokens", build)


def vectors(s, d):
    return base.staged_once(
        s, d, "vectors",
        lambda: features.vectorize(_vectorizer(s, d), _tokens(s, d)).drop("tokens"))


def _parts(s, d):
    use_checkpoints(s)
    rows = vectors(s, d)
    return rows.filter("part = 'train'"), rows.filter("part = 'holdout'")


def _fit(name, **options):
    def query(s, d):
        train, test = _parts(s, d)
        return r.predict(r.fit(name, train, **options), test, name, KEYS)
    return query


def _fit_forest(s, d):
    """MLlib's forest of few rows; its passes over many rows are too many, so tasks grow a few whole trees each."""
    train, test = _parts(s, d)
    if not group_models.oversized(train.unionByName(test).withColumn("all", F.lit(1)), ["all"]):
        return r.predict(r.fit("forest", train), test, "forest", KEYS)
    return experiments.fit_large("forest", train, test)


def _fit_fourier(s, d):
    train, test = _parts(s, d)
    width = len(_vectorizer(s, d).stages[0].vocabulary)
    scored = r.fit_fourier_huber(train, width)(test)
    return scored.select(*KEYS, F.col("storypoint").alias("y"),
                         F.lit("rff_huber").alias("model"), "prediction")


def _fit_stacking(s, d):
    train, test = _parts(s, d)
    role = lambda rows, name: rows.withColumn("role", F.lit(name))
    rows = role(train, "train").unionByName(role(test, "test"))
    return experiments._evaluate([({"split": 1}, rows)], ("stacking",), "stacking", 1).drop("split")


def _tune(s, d):
    train, validation = _parts(s, d)
    found = [(family, *trial) for family in TUNED for trial in r.tune(
        family, train, validation, r.random_trials(family))]
    table = s.createDataFrame(found, "model string, trial int, params string, mae double")
    return scoring.best_trial(table, ["model"])


def _refit(s, d):
    """Per four-way cycle: every model scored on validation, refitted, scored on test."""
    rows = base.corpus(s, d).select(*KEYS, "storypoint", tokenize(F.col("text")).alias("tokens"))
    roles = splits.four_way_roles(rows)
    held = stage(splits.role_rows(rows, roles), "cycle_rows")
    cycles = sorted(row.cycle for row in roles.select("cycle").distinct().collect())

    def run(job):
        cycle, fitted_on, tested_on = job
        part = held.filter(F.col("cycle") == cycle).drop("cycle")
        return {"cycle": cycle, "scored_on": tested_on}, experiments.vectors_of(part, fitted_on, tested_on, "refit")

    parts = r.in_parallel([(cycle, *step) for cycle in cycles for step in (
        (["train"], "validation"), (["train", "validation"], "test"))], run)
    made = experiments._evaluate(parts, experiments.MODELS, "refit", 4)
    return scoring.score(made, ["cycle", "scored_on", "model"], digits=6)


def _tfidf_vectors(s, d):
    """The sparse vectors as one row per entry, to be told apart from SQL weights."""
    raw = F.unwrap_udt("features")
    entries = F.explode(F.arrays_zip(
        raw["indices"].alias("at"), raw["values"].alias("w"))).alias("_e")
    return vectors(s, d).select("dataset_name", "row_ord", "part", entries).select(
        "dataset_name", "row_ord", "part", (F.col("_e.at") + 1).alias("term_rank"),
        F.round("_e.w", 6).alias("weight"))


def _word_vectors(s, d):
    embedded = stages.document_vectors(_tokens(s, d))
    return embedded.select(*KEYS, vector_to_array("_vector").alias("vec"))


def _fresh(s, name):
    return sinks.store_path(staging_root(s), f"{name}-{uuid.uuid4().hex}")


def _curate_incremental(s, d):
    """A store that already holds one project; the others are added to it."""
    path = _fresh(s, "curated_store")
    rows = base.staged_once(s, d, "first_copies", lambda: base.first_copies(s, d))
    sinks.add_missing(rows.filter("dataset_name = 'ds0'"), path, lambda df: df)
    return sinks.add_missing(rows, path, lambda df: df)


def _fold_store(s, d):
    path = _fresh(s, "fold_store")
    rows = ev.points(s, d)
    sinks.add_missing(rows.filter("dataset_name < 'ds2'"), path, splits.kfold_assign)
    return sinks.add_missing(rows, path, splits.kfold_assign)


def _ledger_append(s, d):
    path = _fresh(s, "ledger")
    results = ev.intra_ledger(s, d)
    sinks.append_ledger(results.filter("model LIKE 'knn%'"), path)
    sinks.append_ledger(results.filter("model NOT LIKE 'knn%'"), path)
    return s.read.parquet(path).drop("executed_at")


def _predictions_sink(s, d):
    path = _fresh(s, "predictions")
    rows = ev.oof(s, d).withColumn("prediction", F.round("prediction", 6))
    sinks.write_predictions(rows, path)
    sinks.write_predictions(rows.filter("model = 'knn5'"), path)
    return s.read.parquet(path)


def _evaluate_inter(s, d):
    """Every model over every leave-one-project-out cycle, as ledger rows."""
    path = _fresh(s, "inter_ledger")
    experiments.run_inter(base.curated(s, d), path, ev.VERSION)
    return s.read.parquet(path).drop("executed_at")


def _evaluate_intra(s, d):
    """Every model over every fold of every project, as ledger rows."""
    path = _fresh(s, "intra_ledger")
    experiments.run_intra(base.curated(s, d), path, f"{path}-folds", ev.VERSION)
    return s.read.parquet(path).drop("executed_at")


def _evaluate_ensemble(s, d):
    """Tuned and refitted models over every fold of every project."""
    path = _fresh(s, "ensemble")
    ensemble.run_folds(base.curated(s, d), path, f"{path}-trials", f"{path}-folds", ev.VERSION)
    return s.read.parquet(path).drop("executed_at")


def _evaluate_cyclic(s, d):
    """Tuned and refitted models over every four-way cycle of projects."""
    path = _fresh(s, "cyclic")
    ensemble.run_cycles(base.curated(s, d), path, f"{path}-trials", ev.VERSION)
    return s.read.parquet(path).drop("executed_at")


QUERIES = {
    "evaluate_ensemble": _evaluate_ensemble,
    "evaluate_cyclic": _evaluate_cyclic,
    "evaluate_inter": _evaluate_inter,
    "evaluate_intra": _evaluate_intra,
    "tfidf_vectors": _tfidf_vectors,
    "fit_linear": _fit("linear"),
    "fit_ridge": _fit("ridge"),
    "fit_lasso": _fit("lasso"),
    "fit_elasticnet": _fit("elastic_net"),
    "fit_rff_huber": _fit_fourier,
    "fit_tree": _fit("tree"),
    "fit_forest": _fit_forest,
    "fit_gbt_deep": _fit("boosted_deep"),
    "fit_gbt_shallow": _fit("boosted_shallow"),
    "fit_stacking": _fit_stacking,
    "tune_random": _tune,
    "refit_train_val": _refit,
    "embed_word2vec": _word_vectors,
    "curate_incremental": _curate_incremental,
    "fold_store": _fold_store,
    "ledger_append": _ledger_append,
    "predictions_sink": _predictions_sink,
}

o.BLOCKS["parts"] = (["capped"], """SELECT dataset_name, issuekey, row_ord, CASE WHEN
    row_number() OVER (PARTITION BY dataset_name
      ORDER BY md5('holdout42:' || issuekey || ':' || row_ord))
    <= ceil(count(*) OVER (PARTITION BY dataset_name) * CAST(0.2 AS DOUBLE))
  THEN 'holdout' ELSE 'train' END AS part FROM capped""")

ORACLES = {
    "tfidf_vectors": o.with_blocks(["terms", "parts"], """
SELECT dataset_name, row_ord, part, CAST(term_rank AS INTEGER) AS term_rank,
  round(w / sqrt(sum(w * w) OVER (PARTITION BY row_ord)), 6) AS weight
FROM (SELECT *, tf * (ln((1 + (SELECT count(*) FROM parts WHERE part = 'train'))
    / CAST(1 + df AS DOUBLE)) + 1) AS w
  FROM terms JOIN parts USING (dataset_name, issuekey, row_ord) JOIN (
    SELECT term, count(*) AS df, row_number() OVER (ORDER BY sum(tf) DESC, term) AS term_rank
    FROM terms JOIN parts USING (dataset_name, issuekey, row_ord) WHERE part = 'train'
    GROUP BY term QUALIFY term_rank <= 5000) USING (term))"""),
    "curate_incremental": o.with_blocks(["first_copies"], "SELECT * FROM first_copies"),
    "fold_store": o.with_blocks(["folds"], "SELECT * FROM folds"),
    "ledger_append": ev.ORACLES["fold_summary"].replace(
        "SELECT dataset_name, model, round(avg(mae)",
        f"SELECT '{ev.VERSION}' AS version, dataset_name, model, round(avg(mae)"),
    "predictions_sink": ev.ORACLES["oof_predictions"],
}
