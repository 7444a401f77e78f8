"""Registered queries: splits, features, neighbours, scores and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon
from ..operators import features, lookup, neighbours, scaling, scoring, splits
from ..sources import sinks
from . import base, oracles as o

ROW = ["dataset_name", "issuekey", "row_ord"]
SPLIT = ["dataset_name", "split"]
INNER = [*SPLIT, "inner"]
MODELS = ["train_mean", "train_median", "linear", "ridge", "lasso", "elastic_net",
          "rff_huber", "knn3", "knn5", "tree", "forest", "boosted_deep",
          "boosted_shallow", "stacking", "dynamic"]
VERSION = "v1"


def points(s, d):
    return base.curated(s, d).select(*ROW, "storypoint")


def folds(s, d):
    return base.staged_once(s, d, "folds", lambda: splits.kfold_assign(points(s, d)))


def intra(s, d):
    return base.staged_once(s, d, "intra", lambda: splits.intra_roles(folds(s, d)))


def bags(s, d):
    return base.staged_once(s, d, "bags", lambda: features.term_bags(base.corpus(s, d), ROW))


def tfidf(s, d):
    return base.staged_once(
        s, d, "tfidf",
        lambda: features.tfidf_rows(bags(s, d), intra(s, d), SPLIT, ROW))


def intra_neighbours(s, d):
    def build():
        rows = tfidf(s, d).withColumn("row_id", F.col("row_ord"))
        return neighbours.knn_sparse(
            rows.filter("role = 'test'"), rows.filter("role = 'train'"), SPLIT)
    return base.staged_once(s, d, "neighbours", build)


def labelled_neighbours(s, d):
    rows = points(s, d).select("dataset_name", F.col("row_ord").alias("row_id"), "storypoint")
    return neighbours.attach_rows(intra_neighbours(s, d), rows, ["dataset_name"])


def knn_predictions(s, d):
    found = lookup.average_of_neighbours(
        labelled_neighbours(s, d), [*SPLIT, "query_id"], [3, 5])
    truth = points(s, d).withColumnRenamed("row_ord", "query_id")
    return found.join(truth, ["dataset_name", "query_id"]).select(
        *SPLIT, "issuekey", F.col("query_id").alias("row_ord"),
        F.col("storypoint").alias("y"), "model", "prediction")


def oof(s, d):
    """Out-of-fold predictions of the rules and the neighbour models."""
    def build():
        rows = intra(s, d).join(points(s, d), ROW)
        rules = scoring.rule_predictions(rows, SPLIT, ["issuekey", "row_ord"])
        return rules.unionByName(knn_predictions(s, d))
    return base.staged_once(s, d, "oof", build)


def inter_predictions(s, d):
    rows = splits.role_rows(points(s, d), splits.leave_one_out_roles(points(s, d)))
    return scoring.rule_predictions(rows, ["cycle"], ["dataset_name", "row_ord"])


def _metric(name):
    return lambda s, d: scoring.score(oof(s, d), ["dataset_name", "model"], [name], 6)


def _metric_sql(name):
    return o.with_blocks(["predictions"], f"""
SELECT dataset_name, model, round({o.SQL_METRICS[name]}, 6) + 0.0 AS {name}
FROM predictions GROUP BY dataset_name, model""")


def intra_ledger(s, d):
    summary = scoring.fold_summary(oof(s, d), ["dataset_name", "model"], "split")
    return summary.withColumn("version", F.lit(VERSION))


def inter_ledger(s, d):
    scores = scoring.score(inter_predictions(s, d), ["cycle", "model"], digits=6)
    labels = splits.train_label(splits.leave_one_out_roles(points(s, d)))
    return scores.join(labels, "cycle").withColumn("version", F.lit(VERSION))


def _pending_intra(s, d):
    work = splits.intra_grid(points(s, d), MODELS, VERSION)
    return splits.pending(work, intra_ledger(s, d), splits.INTRA_KEY)


def _pending_inter(s, d):
    labels = splits.train_label(splits.leave_one_out_roles(points(s, d)))
    work = splits.inter_grid(labels, MODELS, VERSION)
    return splits.pending(work, inter_ledger(s, d), splits.INTER_KEY)


def _weights(s, d):
    rows = tfidf(s, d)
    pairs = F.explode(F.arrays_zip("idx", "val")).alias("_p")
    return rows.select(*SPLIT, "row_ord", "role", pairs).select(
        *SPLIT, "row_ord", "role", (F.col("_p.idx") + 1).alias("term_rank"),
        F.round("_p.val", 6).alias("weight"))


def _ledger_dedup(s, d):
    """Every experiment recorded by two runs, kept once whatever their stamps."""
    ledger = intra_ledger(s, d).select(*splits.INTRA_KEY, "mae_mean")
    runs = [ledger.withColumn("executed_at", F.lit(at).cast("timestamp"))
            for at in ("2024-01-01 00:00:00", "2024-01-02 00:00:00")]
    return sinks.ledger_dedup(runs[0].unionByName(runs[1]), splits.INTRA_KEY).drop("executed_at")


def _trials(s, d):
    """Trial table of the neighbour model: k is the parameter under search."""
    per_k = scoring.score(oof(s, d).filter("model LIKE 'knn%'"), [*SPLIT, "model"], ["mae"], 6)
    return per_k.select(
        *SPLIT, "mae", F.regexp_replace("model", "knn", "").cast("int").alias("trial"),
        F.concat(F.lit("k="), F.regexp_replace("model", "knn", "")).alias("params"))


def _scaled(s, d):
    rows = intra(s, d).join(points(s, d), ROW)
    scaler = scaling.fit_scaler(rows.filter("role = 'train'"), SPLIT)
    return scaling.scale(rows, scaler, SPLIT), scaler


def _scale_target(s, d):
    scaled, _ = _scaled(s, d)
    return scaled.select(*SPLIT, "row_ord", F.round("scaled", 6).alias("scaled"))


def _unscale_target(s, d):
    scaled, scaler = _scaled(s, d)
    restored = scaling.unscale(scaled, scaler, SPLIT)
    return restored.select(*SPLIT, "row_ord", F.round("restored", 6).alias("restored"))


def inner_roles(s, d):
    """Train rows of each split, dealt again: each of their folds is held out once."""
    train = intra(s, d).filter("role = 'train'").drop("role").join(folds(s, d), ROW)
    inner = F.explode(F.sequence(F.lit(1), F.lit(lexicon.FOLDS))).alias("inner")
    return train.select("*", inner).filter("inner <> split").select(
        *INNER, "issuekey", "row_ord",
        F.when(F.col("fold") == F.col("inner"), "test").otherwise("train").alias("role"))


def held_predictions(s, d):
    """Predictions for train rows by models that saw neither their fold nor the split's test rows."""
    def build():
        roles = inner_roles(s, d)
        rows = tfidf(s, d).filter("role = 'train'").drop("role").join(roles, [*SPLIT, "issuekey", "row_ord"])
        rows = rows.withColumn("row_id", F.col("row_ord"))
        near = neighbours.knn_sparse(rows.filter("role = 'test'"), rows.filter("role = 'train'"), INNER)
        labels = points(s, d).select("dataset_name", F.col("row_ord").alias("row_id"), "storypoint")
        found = lookup.average_of_neighbours(
            neighbours.attach_rows(near, labels, ["dataset_name"]), [*INNER, "query_id"], [3, 5])
        truth = labels.select("dataset_name", F.col("row_id").alias("query_id"), F.col("storypoint").alias("y"))
        found = found.join(truth, ["dataset_name", "query_id"]).withColumnRenamed("query_id", "row_ord")
        rules = scoring.rule_predictions(roles.join(points(s, d), ROW), INNER, ["row_ord"])
        return rules.unionByName(found)
    return base.staged_once(s, d, "held", build)


def local_errors(s, d):
    """Mean absolute error of each model on a query's neighbours.

    Neighbours are train rows of the query's split. Their errors are those of models
    fitted inside that split's train rows, so no label of a test row takes part.
    """
    near = intra_neighbours(s, d).select(
        *SPLIT, "query_id", F.col("neighbour_id").alias("row_ord"))
    errors = held_predictions(s, d).select(
        *SPLIT, "row_ord", "model", F.abs(F.col("y") - F.col("prediction")).alias("error"))
    return near.join(errors, [*SPLIT, "row_ord"]).groupBy(
        *SPLIT, "query_id", "model").agg(F.round(F.avg("error"), 9).alias("local_error"))


def predict_des(s, d):
    keys = [*SPLIT, "query_id"]
    weights = lookup.select_and_weigh(local_errors(s, d), keys)
    predictions = oof(s, d).withColumnRenamed("row_ord", "query_id")
    return lookup.dynamic_ensemble(predictions, weights, keys).select(
        *keys, F.round("prediction", 6).alias("prediction"))


QUERIES = {
    "kfold_assign": lambda s, d: splits.kfold_assign(points(s, d)),
    "fold_join": lambda s, d: splits.fold_join(points(s, d), folds(s, d)),
    "holdout_split": lambda s, d: splits.holdout_split(points(s, d)),
    "cycle_roles_loo": lambda s, d: splits.leave_one_out_roles(points(s, d)),
    "cycle_roles_4way": lambda s, d: splits.four_way_roles(points(s, d)),
    "inter_roles_rows": lambda s, d: splits.role_rows(
        points(s, d), splits.leave_one_out_roles(points(s, d))),
    "cyclic_roles_rows": lambda s, d: splits.role_rows(
        points(s, d), splits.four_way_roles(points(s, d))),
    "train_label": lambda s, d: splits.train_label(splits.leave_one_out_roles(points(s, d))),
    "experiment_grid": lambda s, d: splits.intra_grid(
        points(s, d), MODELS, VERSION, lexicon.FOLDS),
    "split_sizes": lambda s, d: splits.split_sizes(intra(s, d), SPLIT),
    "pending_intra": _pending_intra,
    "pending_inter": _pending_inter,
    "term_df": lambda s, d: features.term_df(bags(s, d)),
    "top_terms": lambda s, d: features.top_terms(features.term_df(bags(s, d))),
    "tfidf_weights": _weights,
    "knn_tfidf": lambda s, d: intra_neighbours(s, d).select(
        *SPLIT, "query_id", "neighbour_id", "rank", F.round("distance", 6).alias("distance")),
    "predict_knn": lambda s, d: knn_predictions(s, d).filter("model = 'knn5'").select(
        *SPLIT, "row_ord", F.round("prediction", 6).alias("prediction")),
    "oof_predictions": lambda s, d: oof(s, d).select(
        *SPLIT, "issuekey", "row_ord", "model", "y", F.round("prediction", 6).alias("prediction")),
    "metric_mae": _metric("mae"),
    "metric_r2": _metric("r2"),
    "metric_rmse": _metric("rmse"),
    "metric_mse": _metric("mse"),
    "metric_pearson": _metric("pearson"),
    "metrics_by_model": lambda s, d: scoring.score(oof(s, d), ["model"], digits=6),
    "fold_summary": lambda s, d: scoring.fold_summary(oof(s, d), ["dataset_name", "model"], "split"),
    "inter_summary": lambda s, d: inter_ledger(s, d),
    "scale_target": _scale_target,
    "unscale_target": _unscale_target,
    "ledger_dedup": _ledger_dedup,
    "best_trial": lambda s, d: scoring.best_trial(_trials(s, d), SPLIT),
    "predict_des": predict_des,
}

_SUMMARY = ", ".join(
    f"round(avg({n}), 6) + 0.0 AS {n}_mean, round(stddev_pop({n}), 6) + 0.0 AS {n}_std"
    for n in ("mae", "r2", "rmse", "pearson"))
_ALL = ", ".join(f"{o.SQL_METRICS[n]} AS {n}" for n in ("mae", "r2", "rmse", "pearson"))
_ALL6 = ", ".join(
    f"round({o.SQL_METRICS[n]}, 6) + 0.0 AS {n}" for n in ("mae", "r2", "rmse", "pearson"))
_MODELS = o.sql_list(MODELS)
_SCALED = """SELECT r.dataset_name, r.split, r.row_ord, storypoint, center, spread
FROM intra_roles r JOIN capped USING (dataset_name, issuekey, row_ord)
JOIN (SELECT dataset_name, split, avg(storypoint) AS center, CASE WHEN stddev_pop(storypoint) = 0
    THEN 1.0 ELSE stddev_pop(storypoint) END AS spread
  FROM intra_roles JOIN capped USING (dataset_name, issuekey, row_ord)
  WHERE role = 'train' GROUP BY ALL) USING (dataset_name, split)"""

ORACLES = {
    "kfold_assign": o.with_blocks(["folds"], "SELECT * FROM folds"),
    "fold_join": o.with_blocks(["folds"], """
SELECT dataset_name, issuekey, row_ord, storypoint, fold
FROM capped JOIN folds USING (dataset_name, issuekey, row_ord)"""),
    "holdout_split": o.with_blocks(["capped"], """
SELECT dataset_name, issuekey, row_ord, storypoint, CASE WHEN row_number() OVER (
    PARTITION BY dataset_name ORDER BY md5('holdout42:' || issuekey || ':' || row_ord))
  <= ceil(count(*) OVER (PARTITION BY dataset_name) * CAST(0.2 AS DOUBLE))
  THEN 'holdout' ELSE 'train' END AS part FROM capped"""),
    "cycle_roles_loo": o.with_blocks(["loo"], "SELECT * FROM loo"),
    "cycle_roles_4way": o.with_blocks(["four_way"], "SELECT * FROM four_way"),
    "inter_roles_rows": o.with_blocks(["loo"], """
SELECT dataset_name, issuekey, row_ord, storypoint, cycle, role
FROM capped JOIN loo USING (dataset_name)"""),
    "cyclic_roles_rows": o.with_blocks(["four_way"], """
SELECT dataset_name, issuekey, row_ord, storypoint, cycle, role
FROM capped JOIN four_way USING (dataset_name)"""),
    "train_label": o.with_blocks(["labels_loo"], "SELECT * FROM labels_loo"),
    "experiment_grid": o.with_blocks(["names"], f"""
SELECT '{VERSION}' AS version, dataset_name, model, CAST(fold AS INTEGER) AS fold FROM names,
  (SELECT unnest({_MODELS}) AS model), (SELECT unnest(range(1, 6)) AS fold)"""),
    "split_sizes": o.with_blocks(["intra_roles"], """
SELECT dataset_name, split, role, count(*) AS n_rows FROM intra_roles GROUP BY ALL"""),
    "pending_intra": o.with_blocks(["predictions"], f"""
SELECT '{VERSION}' AS version, dataset_name, model FROM names_in,
  (SELECT unnest({_MODELS}) AS model)
WHERE (dataset_name, model) NOT IN (SELECT (dataset_name, model) FROM predictions)""".replace(
        "names_in", "(SELECT DISTINCT dataset_name FROM capped)")),
    "pending_inter": o.with_blocks(["inter_predictions", "labels_loo"], f"""
SELECT '{VERSION}' AS version, train_set, validation, test, model FROM labels_loo,
  (SELECT unnest({_MODELS}) AS model)
WHERE (cycle, model) NOT IN (SELECT (cycle, model) FROM inter_predictions)"""),
    "term_df": o.with_blocks(["terms"], """
SELECT term, CAST(sum(tf) AS BIGINT) AS frequency, count(*) AS df FROM terms GROUP BY term"""),
    "top_terms": o.with_blocks(["terms"], """
SELECT term, CAST(sum(tf) AS BIGINT) AS frequency, count(*) AS df,
  row_number() OVER (ORDER BY sum(tf) DESC, term) AS rank
FROM terms GROUP BY term QUALIFY rank <= 5000"""),
    "tfidf_weights": o.with_blocks(["weights"], """
SELECT dataset_name, split, row_ord, role, term_rank, round(w, 6) AS weight FROM weights JOIN
  (SELECT dataset_name, split, term, row_number() OVER (PARTITION BY dataset_name, split
    ORDER BY frequency DESC, term) AS term_rank FROM vocabulary) USING (dataset_name, split, term)"""),
    "knn_tfidf": o.with_blocks(["neighbours"], """
SELECT dataset_name, split, query_id, neighbour_id, rank, round(distance, 6) AS distance
FROM neighbours"""),
    "predict_knn": o.with_blocks(["predictions"], """
SELECT dataset_name, split, row_ord, round(prediction, 6) AS prediction FROM predictions
WHERE model = 'knn5'"""),
    "oof_predictions": o.with_blocks(["predictions"], """
SELECT dataset_name, split, issuekey, row_ord, model, y, round(prediction, 6) AS prediction
FROM predictions"""),
    "metric_mae": _metric_sql("mae"),
    "metric_r2": _metric_sql("r2"),
    "metric_rmse": _metric_sql("rmse"),
    "metric_mse": _metric_sql("mse"),
    "metric_pearson": _metric_sql("pearson"),
    "metrics_by_model": o.with_blocks(["predictions"], f"""
SELECT model, {_ALL6} FROM predictions GROUP BY model"""),
    "fold_summary": o.with_blocks(["predictions"], f"""
SELECT dataset_name, model, {_SUMMARY} FROM (SELECT dataset_name, model, split, {_ALL}
  FROM predictions GROUP BY ALL) GROUP BY dataset_name, model"""),
    "inter_summary": o.with_blocks(["inter_predictions", "labels_loo"], f"""
SELECT '{VERSION}' AS version, * FROM (SELECT cycle, model, {_ALL6} FROM inter_predictions
  GROUP BY cycle, model) JOIN labels_loo USING (cycle)"""),
    "scale_target": o.with_blocks(["intra_roles"], f"""
SELECT dataset_name, split, row_ord, round((storypoint - center) / spread, 6) + 0.0 AS scaled
FROM ({_SCALED})"""),
    "unscale_target": o.with_blocks(["intra_roles"], f"""
SELECT dataset_name, split, row_ord, round((storypoint - center) / spread * spread + center, 6)
  AS restored FROM ({_SCALED})"""),
    "ledger_dedup": o.with_blocks(["predictions"], f"""
SELECT '{VERSION}' AS version, dataset_name, model, round(avg(mae), 6) AS mae_mean FROM
  (SELECT dataset_name, model, split, {o.SQL_METRICS['mae']} AS mae FROM predictions GROUP BY ALL)
GROUP BY dataset_name, model"""),
    "best_trial": o.with_blocks(["predictions"], f"""
SELECT dataset_name, split, trial, 'k=' || trial AS params, mae FROM (
  SELECT dataset_name, split, CAST(replace(model, 'knn', '') AS INTEGER) AS trial,
    round({o.SQL_METRICS['mae']}, 6) AS mae
  FROM predictions WHERE model LIKE 'knn%' GROUP BY dataset_name, split, model)
QUALIFY row_number() OVER (PARTITION BY dataset_name, split ORDER BY mae, trial) = 1"""),
    "predict_des": o.with_blocks(["predictions", "held"], """
SELECT dataset_name, split, query_id, round(sum(prediction / (local_error + 1e-6::DOUBLE))
  / sum(1 / (local_error + 1e-6::DOUBLE)), 6) AS prediction
FROM (SELECT *, avg(local_error) OVER (PARTITION BY dataset_name, split, query_id) AS mean_error
  FROM (SELECT n.dataset_name, n.split, query_id, model, round(avg(abs(y - prediction)), 9)
      AS local_error
    FROM neighbours n JOIN held p ON p.dataset_name = n.dataset_name
      AND p.split = n.split AND p.row_ord = n.neighbour_id GROUP BY ALL))
  JOIN (SELECT dataset_name, split, row_ord AS query_id, model, prediction FROM predictions)
  USING (dataset_name, split, query_id, model)
WHERE local_error <= mean_error + 1e-12::DOUBLE GROUP BY ALL"""),
}
