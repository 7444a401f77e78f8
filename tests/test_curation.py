import pytest
from pyspark.sql import functions as F

from sprintgauge.operators import curate as ops, stats
from sprintgauge.plans import base
from sprintgauge.sources import projects, sinks, tables

SCHEMA = "dataset_name string, row_ord long, issuekey string, title string, description string, storypoint double"
ENGLISH = "the user and the page of it"


def raw(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_curate_edges(spark):
    rows = raw(spark, [
        ("a", 1, "K1", None, ENGLISH, 3.0), ("a", 2, "K2", "T", ENGLISH, 2.0),
        ("a", 3, "K3", "T", ENGLISH, 5.0), ("a", 4, "K4", "T", " \t\x1c", 3.0),
        ("a", 5, "K5", "T", ENGLISH, None), ("a", 6, "K6", "T", ENGLISH, 0.0),
        ("a", 7, "K7", "T", ENGLISH, 13.0), ("b", 8, "K8", "T", ENGLISH, 8.0),
        ("x-titanium", 9, "K9", "T", ENGLISH, 3.0), ("b", 10, "K10", "T", "der die und das", 3.0)])
    kept = {r.issuekey: r.description for r in ops.curate(rows).collect()}
    assert kept == {"K1": f"nan {ENGLISH}", "K2": f"T {ENGLISH}", "K8": f"T {ENGLISH}"}
    assert {r.issuekey for r in ops.curate(rows, limit=1).collect()} == {"K1", "K8"}
    capped = ops.uniform_cap(ops.curate(rows))
    assert {r.issuekey for r in capped.collect()} == {"K1", "K2"}


def test_cap_of_no_rows(spark):
    assert ops.uniform_cap(raw(spark, [])).count() == 0
    assert stats.dataset_stats(raw(spark, [])).count() == 0


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_dedup_keeps_the_first_copy(spark, partitions):
    rows = spark.range(600).select(
        F.lit("a").alias("dataset_name"), F.col("id").alias("row_ord"),
        F.concat(F.lit("K"), F.col("id")).alias("issuekey"),
        F.when(F.col("id") % 2 == 0, "copy").otherwise(F.concat(F.lit("t"), F.col("id") % 50))
        .alias("description"), F.lit(1.0).alias("storypoint"))
    kept = ops.dedup_first(rows.repartition(partitions)).collect()
    assert sorted(r.row_ord for r in kept) == [0, *range(1, 50, 2)]


def test_known_counts(spark):
    found = ops.curate(tables.requirements(spark, "/root/testdata/sf0.001"), detect=False)
    assert found.count() == 103
    assert ops.uniform_cap(found).count() == 88


def test_scan_by_header(spark, tmp_path):
    (tmp_path / "alpha.csv").write_text(
        'extra,title,description,storypoint,issuekey\n'
        '1,"T, one","line one\nline ""two""",3,A-1\n2,NA,null,5.0,A-2\n3,T,x,,A-3\n', encoding="utf8")
    (tmp_path / "beta.csv").write_text(
        "issuekey,storypoint,description,title\nB-1,2,text,T\nB-2,abc,text,T\n", encoding="utf8")
    (tmp_path / "titanium-x.csv").write_text(
        "issuekey,storypoint,description,title\nC-1,2,text,T\n", encoding="utf8")
    (tmp_path / "other.csv").write_text("a,treated_description_bert\n1,hello\n", encoding="utf8")
    rows = {r.issuekey: r for r in projects.scan_requirements(spark, str(tmp_path)).collect()}
    assert set(rows) == {"A-1", "A-2", "A-3", "B-1", "B-2"}
    assert rows["A-1"].description == 'line one\nline "two"' and rows["A-1"].title == "T, one"
    assert rows["A-2"].description is None and rows["A-2"].title is None
    assert (rows["A-2"].storypoint, rows["A-3"].storypoint, rows["B-2"].storypoint) == (5.0, None, None)
    assert rows["A-1"].row_ord < rows["A-2"].row_ord < rows["A-3"].row_ord
    assert rows["B-1"].dataset_name == "beta"
    assert [r.text for r in projects.language_corpus(spark, str(tmp_path)).collect()] == ["hello"]
    assert projects.retrieval_corpus(spark, str(tmp_path)).count() == 4
    with pytest.raises(ValueError, match="has the columns"):
        projects.scan_columns(spark, str(tmp_path), ["nowhere"])


def test_store_adds_only_missing_projects(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = raw(spark, [("a", 1, "K1", "T", "x", 1.0), ("b", 2, "K2", "T", "y", 2.0)])
    sinks.add_missing(rows.filter("dataset_name = 'a'"), path, lambda df: df)
    changed = rows.withColumn("storypoint", F.lit(9.0))
    stored = {r.dataset_name: r.storypoint for r in
              sinks.add_missing(changed, path, lambda df: df).collect()}
    assert stored == {"a": 1.0, "b": 9.0}
    assert sinks.store_path("/r/", "s", limit=5) == "/r/s/limit-5"


def test_ledger_refuses_other_columns(spark, tmp_path):
    path = str(tmp_path / "ledger")
    sinks.append_ledger(spark.createDataFrame([("m", 1.0)], "model string, mae double"), path)
    with pytest.raises(ValueError, match="ledger columns differ"):
        sinks.append_ledger(spark.createDataFrame([("m", 1)], "model string, mae int"), path)
    sinks.append_ledger(spark.createDataFrame([(2.0, "n")], "mae double, model string"), path)
    assert {r.model: r.mae for r in spark.read.parquet(path).collect()} == {"m": 1.0, "n": 2.0}


def test_views(spark):
    df = spark.createDataFrame([("Fixing <b>bugs</b> in the pages",), (None,)], "description string")
    assert [r.treated_description for r in ops.treat(df, "bert").collect()] == ["Fixing bugs in the pages", ""]
    assert [r.treated_description for r in ops.treat(df, "ml").collect()] == ["fix bug page", ""]


def test_staged_tables_use_the_shared_folder(spark, sf_dir):
    files = base.curated(spark, sf_dir).inputFiles()
    assert files and all(spark.conf.get("spark.checkpoint.dir") in f for f in files)


def test_an_export_may_be_a_folder_of_parts(spark, tmp_path):
    names = ["aa", "b c+d=50%"]
    rows = spark.range(40).select(
        F.when(F.col("id") % 2 == 0, names[0]).otherwise(names[1]).alias("dataset_name"),
        F.concat(F.lit("k"), "id").alias("issuekey"), F.lit("t").alias("title"),
        F.lit("some text").alias("description"), F.lit(3).alias("storypoint"))
    rows.repartition(3).write.partitionBy("dataset_name").option("header", True).csv(str(tmp_path / "x"))
    assert projects.project_names(spark, str(tmp_path / "x")) == set(names)
    found = projects.scan_requirements(spark, str(tmp_path / "x")).collect()
    for at, name in enumerate(names):
        mine = [r for r in found if r.dataset_name == name]
        assert sorted(r.row_ord for r in mine) == list(range(20))
        assert {r.issuekey for r in mine} == {f"k{i}" for i in range(at, 40, 2)}
