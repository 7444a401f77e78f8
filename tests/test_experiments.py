import pytest
from pyspark.sql import functions as F

from sprintgauge.plans import base, experiments


def write_exports(root, names):
    root.mkdir(exist_ok=True)
    for at, name in enumerate(names):
        lines = ["issuekey,title,description,storypoint"]
        for i in range(12):
            lines.append(f"{name}-{i},T{i},the page and button {i} of form {i % 3} {name},{(i + at) % 3 + 1}")
        (root / f"{name}.csv").write_text("\n".join(lines) + "\n", encoding="utf8")


def test_a_whole_run_and_its_repeat(spark, tmp_path):
    write_exports(tmp_path / "raw", ["aa", "bb", "titanium"])
    raw, store = str(tmp_path / "raw"), str(tmp_path / "store")
    rows = experiments.load_projects(spark, raw, store)
    assert {r.dataset_name for r in rows.select("dataset_name").distinct().collect()} == {"aa", "bb"}
    write_exports(tmp_path / "raw", ["aa", "bb", "cc", "titanium"])
    rows = experiments.load_projects(spark, raw, store)
    assert rows.groupBy("dataset_name").count().filter("count = 12").count() == 3
    assert experiments.load_projects(spark, raw, store, limit=5).count() == 15

    ledger, folds = str(tmp_path / "intra"), str(tmp_path / "folds")
    made = experiments.run_intra(rows, ledger, folds, "v", ("lasso",))
    assert made.count() == 36 and spark.read.parquet(ledger).count() == 3
    assert experiments.run_intra(rows, ledger, folds, "v", ("lasso",)) is None
    more = experiments.run_intra(rows, ledger, folds, "v", ("lasso", "elastic_net"))
    assert {r.model for r in more.select("model").distinct().collect()} == {"elastic_net"}

    inter = str(tmp_path / "inter")
    assert experiments.run_inter(rows, inter, "v", ("lasso",)).count() == 36
    assert experiments.run_inter(rows, inter, "v", ("lasso",)) is None
    labels = {(r.train_set, r.validation, r.test) for r in spark.read.parquet(inter).collect()}
    assert labels == {("cc", "bb", "aa"), ("aa", "cc", "bb"), ("bb", "aa", "cc")}


def test_baseline_needs_no_detection_twice(spark, sf_dir):
    assert base.curated(spark, sf_dir).filter(F.col("storypoint") > 8).count() == 0


def test_folds_cover_rows_that_came_later(spark, tmp_path):
    rows = lambda n: spark.range(n).selectExpr("'p' AS dataset_name", "CAST(NULL AS STRING) AS issuekey", "id AS row_ord")
    path = str(tmp_path / "folds")
    for n in (10, 40, 40, 25):
        folds = experiments.covering_folds(rows(n), path)
        assert [r["count"] for r in folds.groupBy("fold").count().collect()] == [n // 5] * 5
        assert sorted(r.row_ord for r in folds.collect()) == list(range(n))


def test_row_numbers_do_not_depend_on_packing(spark, tmp_path):
    from sprintgauge.sources import projects

    write_exports(tmp_path / "raw", ["aa", "bb", "cc"])
    found = []
    for size, cost in (("128m", "4m"), ("200", "1"), ("10m", "0")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        rows = projects.scan_requirements(spark, str(tmp_path / "raw"), multi_line=False)
        found.append(sorted((r.dataset_name, r.row_ord, r.issuekey) for r in rows.collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    write_exports(tmp_path / "raw" / "more", ["aa"])
    with pytest.raises(ValueError, match="aa.csv"):
        projects.scan_requirements(spark, str(tmp_path / "raw"))
    assert found[0] == found[1] == found[2] == [(p, i, f"{p}-{i}") for p in ("aa", "bb", "cc") for i in range(12)]


def test_a_broken_run_keeps_what_it_finished(spark, tmp_path, monkeypatch):
    write_exports(tmp_path / "raw", ["aa", "bb"])
    rows = experiments.load_projects(spark, str(tmp_path / "raw"), str(tmp_path / "store"))
    ledger, folds, real = str(tmp_path / "ledger"), str(tmp_path / "folds"), experiments._evaluate

    def breaks(parts, models, name, threads):
        if parts[0][1].first().dataset_name == "bb":
            raise RuntimeError("lost")
        return real(parts, models, name, threads)

    monkeypatch.setattr(experiments, "_evaluate", breaks)
    try:
        experiments.run_intra(rows, ledger, folds, "v", ("lasso",))
    except RuntimeError:
        pass
    assert [r.dataset_name for r in spark.read.parquet(ledger).collect()] == ["aa"]
    monkeypatch.setattr(experiments, "_evaluate", real)
    made = experiments.run_intra(rows, ledger, folds, "v", ("lasso",))
    assert {r.dataset_name for r in made.select("dataset_name").distinct().collect()} == {"bb"}
