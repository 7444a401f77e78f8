"""Dynamic selection: a row's own label takes no part in its prediction."""

import pandas as pd
from pyspark.sql import functions as F

from sprintgauge.plans import evaluation


def _predictions(spark, sf_dir):
    rows = evaluation.predict_des(spark, sf_dir).collect()
    return {(r.dataset_name, r.split, r.query_id): r.prediction for r in rows}


def test_a_changed_label_leaves_its_own_prediction(spark, sf_dir, tmp_path):
    rows = evaluation.points(spark, sf_dir).filter("dataset_name = 'ds3' AND storypoint = 1")
    changed = rows.agg(F.min("row_ord")).first()[0]
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    # A multiple of 29 and 97 changes the points and neither title nor text.
    docs.loc[docs.doc_id == changed, "n_chars"] += 29 * 97
    docs.to_parquet(tmp_path / "documents.parquet")
    other = str(tmp_path)
    label = evaluation.points(spark, other).filter(F.col("row_ord") == changed).first().storypoint
    assert label == 5
    before, after = _predictions(spark, sf_dir), _predictions(spark, other)
    assert before.keys() == after.keys()
    own = [key for key in before if key[2] == changed]
    assert own and all(before[key] == after[key] for key in own)
    assert any(before[key] != after[key] for key in before)


def test_held_rows_never_meet_their_own_fold(spark, sf_dir):
    roles = evaluation.inner_roles(spark, sf_dir)
    folds = evaluation.folds(spark, sf_dir).select("dataset_name", "row_ord", "fold")
    wrong = roles.join(folds, ["dataset_name", "row_ord"]).filter(
        "fold = split OR (role = 'train') = (fold = inner)")
    assert wrong.count() == 0
