import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sprintgauge.operators import features, language_model as lm, lookup, neighbours, regressors as r
from sprintgauge.operators import scaling, scoring
from sprintgauge.operators.stages import EffortEvaluator, TextTreatment


def predictions(spark, pairs):
    return spark.createDataFrame([("g", float(y), float(p)) for y, p in pairs],
                                 "g string, y double, prediction double")


@pytest.mark.parametrize("pairs", [
    [(1, 1), (2, 2.5), (3, 2), (8, 5)], [(3, 1), (3, 2)], [(3, 3), (3, 3)], [(1, 2), (5, 2)], [(4, 2)]])
def test_metrics(spark, pairs):
    y, p = np.array(pairs, dtype=float).T
    got = scoring.score(predictions(spark, pairs), ["g"], ["mae", "mse", "rmse", "r2", "pearson"]).first()
    assert got.mae == pytest.approx(np.abs(y - p).mean())
    assert got.mse == pytest.approx(((y - p) ** 2).mean())
    assert got.rmse == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    total = ((y - y.mean()) ** 2).sum()
    r2 = 1 - ((y - p) ** 2).sum() / total if total else float((y == p).all())
    assert got.r2 == pytest.approx(r2)
    varies = y.std() > 0 and p.std() > 0
    assert got.pearson == (pytest.approx(np.corrcoef(y, p)[0, 1]) if varies else None)


def test_scaler_of_a_constant(spark):
    rows = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0), ("b", 3.0)], "d string, storypoint double")
    scaler = scaling.fit_scaler(rows, ["d"])
    scaled = scaling.scale(rows, scaler, ["d"])
    assert sorted(x.scaled for x in scaled.collect()) == [-1.0, 0.0, 0.0, 1.0]
    restored = scaling.unscale(scaled, scaler, ["d"]).collect()
    assert all(x.restored == x.storypoint for x in restored)


def brute(queries, candidates, k, exclude_self):
    out = {}
    for qid, q in queries.items():
        ranked = sorted((round(float(((q - c) ** 2).sum()), 9), cid) for cid, c in candidates.items()
                        if not (exclude_self and cid == qid))
        out[qid] = [cid for _, cid in ranked[:k]]
    return out


def as_lists(found):
    out = {}
    for row in sorted(found.collect(), key=lambda x: (x.query_id, x["rank"])):
        out.setdefault(row.query_id, []).append(row.neighbour_id)
    return out


@pytest.mark.parametrize("block_rows", [8192, 40])
@pytest.mark.parametrize("exclude_self", [True, False])
def test_knn_vectors_is_exact(spark, block_rows, exclude_self):
    draw = np.random.default_rng(1)
    points = np.vstack([draw.normal(c, 0.3, size=(60, 3)) for c in (0, 5, 9)]).astype(np.float32)
    points[100:160] = points[100]  # a third of the rows are copies
    vectors = {i: p.astype(float) for i, p in enumerate(points)}
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)],
                               "row_id long, vec array<float>")
    found = neighbours.knn_vectors(df, df, 3, exclude_self, block_rows)
    assert as_lists(found) == brute(vectors, vectors, 3, exclude_self)


@pytest.mark.parametrize("block_rows", [8192, 7])
def test_knn_sparse_is_exact(spark, block_rows):
    draw = np.random.default_rng(2)
    dense, rows = {}, []
    for i in range(40):
        v = draw.random(12) * (draw.random(12) < 0.3)
        v = v / np.linalg.norm(v) if i % 9 and v.any() else np.zeros(12)
        dense[i] = v
        at = np.flatnonzero(v)
        rows.append(("s", i, [int(x) for x in at], [float(v[x]) for x in at]))
    df = spark.createDataFrame(rows, "split string, row_id long, idx array<int>, val array<double>")
    found = neighbours.knn_sparse(df.filter("row_id < 15"), df.filter("row_id >= 15"), ["split"], 4,
                                  block_rows=block_rows)
    expected = brute({i: dense[i] for i in range(15)}, {i: dense[i] for i in range(15, 40)}, 4, False)
    assert as_lists(found) == expected


@pytest.mark.parametrize("long", [0, 6, 1000])
def test_dots_of_postings(monkeypatch, long):
    import pandas as pd

    monkeypatch.setattr(neighbours, "_LONG", long)
    draw = np.random.default_rng(4)
    dense = [draw.random((n, 9)) * (draw.random((n, 9)) < 0.4) for n in (7, 11)]
    frames = [pd.DataFrame({"idx": [np.flatnonzero(v) * 10**15 for v in m], "val": [v[v != 0] for v in m]}) for m in dense]
    q, c = (neighbours._Postings(f) for f in frames)
    assert np.allclose(neighbours._dots(q, c), dense[0] @ dense[1].T)
    none = neighbours._Postings(frames[0].assign(idx=[[]] * 7, val=[[]] * 7))
    assert not neighbours._dots(none, c).any() and not none.lengths.any()


@pytest.mark.parametrize("long", [0, 6, 1000])
def test_terms_of_most_rows_and_of_few_add_up(monkeypatch, long):
    import pandas as pd

    monkeypatch.setattr(neighbours, "_LONG", long)
    monkeypatch.setattr(neighbours, "_QUERIES", 3)
    monkeypatch.setattr(neighbours, "_GROUP", 2)
    draw = np.random.default_rng(6)
    dense = draw.random((60, 40)) * (draw.random((60, 40)) < draw.random(40) ** 2)
    dense[::7] = 0
    dense /= np.maximum(np.linalg.norm(dense, axis=1), 1e-12)[:, None]
    frame = pd.DataFrame({"row_id": np.arange(60), "idx": [np.flatnonzero(v) * 10**15 for v in dense],
                          "val": [v[v != 0] for v in dense]})
    found = neighbours._sparse_block(frame[:20], frame, 4, True)
    full = (dense.any(axis=1)).astype(float)
    for i in range(20):
        d = np.round(full[i] + full - 2 * dense @ dense[i], 9)
        d[i] = np.inf
        wanted = np.lexsort((np.arange(60), d))[:4]
        assert found[found.query_id == i].neighbour_id.tolist() == wanted.tolist()


def test_rounds_bound_the_copies_of_blocks(spark, monkeypatch):
    rows = spark.range(120).selectExpr(
        "'s' AS split", "id AS row_id", "array(int(id % 11), 11 + int(id % 7)) AS idx",
        "array(0.6D, 0.8D) AS val")
    whole = neighbours.knn_sparse(rows, rows, ["split"], 3, True)
    assert neighbours._rounds(rows, rows, ["split"], 8192) == 1
    # 15 blocks a side: 3,600 copies of 240 rows in one go, at most about 2 each in a round.
    assert neighbours._rounds(rows, rows, ["split"], 8) == 8
    sent, real = [], neighbours._blocked
    monkeypatch.setattr(neighbours, "_blocked", lambda asked, *rest: sent.append(asked.count()) or real(asked, *rest))
    parted = neighbours.knn_sparse(rows, rows, ["split"], 3, True, block_rows=8)
    assert len(sent) == 8 and sum(sent) == 120
    assert as_lists(parted) == as_lists(whole)


def test_a_task_regroups_the_terms_of_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(features, "TASK_ROWS", 8, raising=False)
    rows = spark.range(80).selectExpr("concat('p', id % 2) AS dataset_name", "id AS row_ord", "concat('word', id % 5, ' common word') AS text")
    keys = ["dataset_name", "row_ord"]
    bags = features.term_bags(rows, keys)
    roles = rows.selectExpr("dataset_name", "row_ord", "1 AS split", "IF(row_ord % 4 = 0, 'test', 'train') AS role")
    weighed = features.tfidf_rows(bags, roles, ["dataset_name", "split"], keys)
    for made in (bags, weighed):
        sizes = made.groupBy(F.spark_partition_id()).count().collect()  # few bytes: adaptive execution would merge all
        assert len(sizes) > 4 and sum(x["count"] for x in sizes) == 80


def test_terms_a_row_holds_twice_keep_their_count():
    import pandas as pd

    few = pd.DataFrame({"row_id": [1, 2], "idx": [np.array([5, 5, 9]), np.array([5, 9])],
                        "val": [np.array([0.5, 0.5, 0.7]), np.array([0.6, 0.8])]})
    assert neighbours._Postings(few).repeats() and not neighbours._Postings(few[1:]).repeats()
    d = neighbours._repeated_dots(*2 * (neighbours._Postings(few),))
    assert np.allclose(d[0, 1], 2 * 0.5 * 0.6 + 0.7 * 0.8)  # short lists: every pair of entries
    many = pd.concat([few.assign(row_id=few.row_id + 2 * i) for i in range(10)], ignore_index=True)
    d = neighbours._repeated_dots(*2 * (neighbours._Postings(many),))
    assert np.allclose(d[0, 1], 0.5 * 0.6 + 0.7 * 0.8)  # long ones: once


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "row_id long, vec array<float>")
    assert as_lists(neighbours.knn_vectors(df, df, 5, True)) == {1: [2], 2: [1]}


def matrix(spark, n=60, width=6):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(n, width)) * (draw.random((n, width)) < 0.6)
    y = x @ np.array([2.0, -1.0, 0, 0, 3.0, 0.5]) + draw.normal(0, 0.3, n) + 4
    df = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x, y)],
                               ["storypoint", "features"])
    return x, y, df


def descend(x, y, l1, l2, steps=4000):
    """Coordinate descent for 1/2n |y - xw - b|^2 + l1 |w|_1 + l2/2 |w|^2."""
    xc, yc = x - x.mean(0), y - y.mean()
    w, n = np.zeros(x.shape[1]), len(y)
    for _ in range(steps):
        for j in range(len(w)):
            rest = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ rest / n
            w[j] = np.sign(rho) * max(abs(rho) - l1, 0) / (xc[:, j] @ xc[:, j] / n + l2)
    return w, y.mean() - x.mean(0) @ w


@pytest.mark.parametrize("name,l1,l2", [
    ("linear", 0.0, 0.0), ("ridge", 0.0, 1.0 / 60), ("lasso", 0.1, 0.0), ("elastic_net", 0.05, 0.05)])
def test_linear_family_equals_its_objective(spark, name, l1, l2):
    x, y, df = matrix(spark)
    model = r.fit(name, df)
    w, b = descend(x, y, l1, l2)
    assert model.coefficients.toArray() == pytest.approx(w, abs=1e-4)
    assert model.intercept == pytest.approx(b, abs=1e-4)


def test_trees_and_stacking(spark):
    _, y, df = matrix(spark)
    df = df.withColumn("fold", (F.monotonically_increasing_id() % 5 + 1).cast("int"))
    for name in ("tree", "forest", "boosted_deep", "boosted_shallow"):
        got = [p.prediction for p in r.fit(name, df, trees=3).transform(df).collect()]
        assert np.isfinite(got).all()
        again = [p.prediction for p in r.fit(name, df, trees=3).transform(df).collect()]
        assert got == again
    stacked = r.fit_stacking(df, bases=("ridge", "boosted_deep"), trees=3)(df)
    assert EffortEvaluator("mae").evaluate(stacked) < np.abs(y - y.mean()).mean()


def test_fourier_features_learn_a_curve(spark):
    x = np.linspace(-3, 3, 200)
    df = spark.createDataFrame(
        [(float(np.sin(v)), Vectors.sparse(2, [0], [float(v)])) for v in x], ["storypoint", "features"])
    scored = r.fit_fourier_huber(df, 2, components=64)(df)
    assert EffortEvaluator("mae").evaluate(scored) < 0.1


def test_trials_are_seeded_and_in_range():
    trials = r.random_trials("boosted_deep")
    assert trials == r.random_trials("boosted_deep") and len(trials) == 5
    assert all(50 <= t["trees"] <= 200 and 3 <= t["maxDepth"] <= 10 and 0.01 <= t["stepSize"] <= 0.3
               for t in trials)
    assert all(t["maxDepth"] in (10, 15, 20, 25, 30) for t in r.random_trials("forest"))


def test_vectoriser_learns_from_train_only(spark):
    train = spark.createDataFrame([(["aa", "bb", "bb"],), (["aa"],)], "tokens array<string>")
    model = features.fit_vectorizer(train)
    assert model.stages[0].vocabulary == ["aa", "bb"]
    assert list(model.stages[1].getScalingVec()) == pytest.approx([1.0, np.log(3 / 2) + 1])
    test = spark.createDataFrame([(["cc", "bb"],)], "tokens array<string>")
    assert list(features.vectorize(model, test).first().features.toArray()) == [0.0, 1.0]


def test_relational_weights_ignore_test_rows(spark):
    rows = spark.createDataFrame(
        [("d", 1, "aa bb"), ("d", 2, "aa"), ("d", 3, "zz aa"), ("d", 4, "")],
        "dataset_name string, row_ord long, text string")
    roles = spark.createDataFrame(
        [("d", "s", 1, "train"), ("d", "s", 2, "train"), ("d", "s", 3, "test"), ("d", "s", 4, "test")],
        "dataset_name string, split string, row_ord long, role string")
    keys = ["dataset_name", "row_ord"]
    out = {x.row_ord: x for x in features.tfidf_rows(
        features.term_bags(rows, keys), roles, ["dataset_name", "split"], keys).collect()}
    assert (out[3].idx, out[3].val) == ([0], [1.0])
    assert (out[4].idx, out[4].val) == ([], [])
    b = np.log(3 / 2) + 1
    assert out[1].val == pytest.approx([1 / np.hypot(1, b), b / np.hypot(1, b)])


@pytest.mark.parametrize("partitions", [1, 7])
def test_mask_rate_and_seed(spark, partitions):
    rows = spark.range(40).select(
        F.lit("d").alias("dataset_name"), F.col("id").alias("row_ord"),
        F.array_repeat(F.lit(9), 500).alias("input_ids")).repartition(partitions)
    masked = lm.mask_tokens(rows, ["dataset_name", "row_ord"], 100).collect()
    labels = np.array([x.labels for x in sorted(masked, key=lambda x: x.row_ord)])
    shown = np.array([x.input_ids for x in sorted(masked, key=lambda x: x.row_ord)])
    chosen = labels != lm.IGNORED
    assert 0.14 < chosen.mean() < 0.16
    assert 0.77 < (shown[chosen] == lm.MASK).mean() < 0.83
    assert (shown[~chosen] == 9).all() and (labels[chosen] == 9).all()
    again = lm.mask_tokens(rows.repartition(3), ["dataset_name", "row_ord"], 100).collect()
    assert {x.row_ord: x.labels for x in again} == {x.row_ord: x.labels for x in masked}


def test_encode_cuts_and_pads(spark):
    rows = spark.createDataFrame([(1, "b a b"), (2, ""), (3, "a " * 20 + "q")], "row_ord long, text string")
    words = lm.vocabulary(rows, size=2)
    out = {x.row_ord: x for x in lm.encode(rows, words, ["row_ord"], length=8).collect()}
    assert out[1].input_ids == [2, 6, 5, 6, 3, 0, 0, 0]
    assert out[1].attention_mask == [1] * 5 + [0] * 3
    assert out[2].input_ids == [2, 3] + [0] * 6
    assert out[3].input_ids == [2] + [5] * 6 + [3]


def test_dynamic_ensemble(spark):
    errors = spark.createDataFrame([("q", "a", 0.1), ("q", "b", 0.3), ("q", "c", 2.0)],
                                   "q string, model string, local_error double")
    weights = lookup.select_and_weigh(errors, ["q"])
    assert {x.model for x in weights.collect()} == {"a", "b"}
    guesses = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 5.0), ("q", "c", 100.0)],
                                    "q string, model string, prediction double")
    got = lookup.dynamic_ensemble(guesses, weights, ["q"]).first().prediction
    assert got == pytest.approx((1 / 0.100001 + 5 / 0.300001) / (1 / 0.100001 + 1 / 0.300001))


def test_stages(spark):
    df = spark.createDataFrame([("Adding pages",)], "description string")
    assert TextTreatment("ml").transform(df).first().tokens == ["add", "page"]
    assert EffortEvaluator("r2").isLargerBetter() and not EffortEvaluator("mae").isLargerBetter()
