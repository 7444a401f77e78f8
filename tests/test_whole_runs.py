"""Registered model runs do the operator's whole job."""

import pytest
from pyspark.ml.linalg import Vectors

from sprintgauge.operators import regressors as r
from sprintgauge.plans import experiments, modelling


def test_registered_runs_ask_for_everything(monkeypatch):
    asked = {}
    monkeypatch.setattr(modelling.base, "curated", lambda s, d: "rows")
    monkeypatch.setattr(modelling, "_fresh", lambda s, name: name)
    monkeypatch.setattr(experiments, "run_inter", lambda *a, **b: asked.update(inter=(a, b)))
    monkeypatch.setattr(experiments, "run_intra", lambda *a, **b: asked.update(intra=(a, b)))

    class Session:
        read = property(lambda self: self)
        parquet = drop = lambda self, *a: self
        createDataFrame = lambda self, rows, schema: rows

    modelling._evaluate_inter(Session(), "d")
    modelling._evaluate_intra(Session(), "d")
    assert len(asked["inter"][0]) == 3 and len(asked["intra"][0]) == 4  # the default: all models
    assert not asked["inter"][1] and not asked["intra"][1]
    assert len(experiments.MODELS) == 12

    monkeypatch.setattr(modelling, "_parts", lambda s, d: (None, None))
    monkeypatch.setattr(modelling.scoring, "best_trial", lambda rows, keys: rows)
    monkeypatch.setattr(r, "tune", lambda name, a, b, trials: [(i, str(t), 0.0) for i, t in enumerate(trials, 1)])
    found = modelling._tune(Session(), "d")
    assert {row[0] for row in found} == {"forest", "boosted_deep", "boosted_shallow"}
    assert all(row[2] == str(r.random_trials(row[0])[row[1] - 1]) for row in found)


@pytest.mark.parametrize("model", ["rff_huber", "knn5", "stacking", "dynamic"])
def test_composed_models_predict_every_row(spark, monkeypatch, model):
    real = r.fit_stacking
    monkeypatch.setattr(r, "fit_stacking", lambda rows, **o: real(rows, trees=2, **o))
    rows = spark.createDataFrame(
        [("p", f"k{i}", i, float(i % 3 + 1), Vectors.sparse(4, [i % 3], [1.0])) for i in range(40)],
        ["dataset_name", "issuekey", "row_ord", "storypoint", "features"])
    got = experiments.fit_predict(model, rows.filter("row_ord < 30"), rows.filter("row_ord >= 30")).collect()
    assert sorted(x.row_ord for x in got) == list(range(30, 40)) and {x.model for x in got} == {model}
    assert all(abs(x.y - x.prediction) < 0.6 for x in got)
