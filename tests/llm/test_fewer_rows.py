"""Joins of the near-duplicate stage meet few rows."""

from pyspark.sql import functions as F

from sprintgauge.llm import jaccard_join as J


def test_bitmap_keeps_every_wanted_row_and_few_others(spark):
    rows = spark.createDataFrame([(i if i % 7 else None, f"t{i}", i % 3) for i in range(20_000)], "doc_id long, text string, at int")
    wanted = rows.filter("doc_id % 10 = 3").select(F.col("doc_id").alias("doc"))
    twice = rows.unionByName(rows.filter("doc_id = 13"))
    marks = J._Marks.of(wanted, "doc")
    kept = marks.on(twice, "doc_id", "to").filter("to").drop("to")
    assert kept.columns == rows.columns
    assert kept.filter("doc_id % 10 = 3").orderBy("doc_id").collect() == twice.filter("doc_id % 10 = 3").orderBy("doc_id").collect()
    assert kept.filter("doc_id % 10 <> 3").count() < 0.15 * rows.count()
    assert J._Marks.of(wanted.limit(0), "doc").on(rows, "doc_id", "to").filter("to").count() == 0


def test_few_marks_catch_few_of_many_rows(spark):
    """Rows marked by chance are few against the marked ids, however many rows are asked about."""
    rows = spark.range(200_000).withColumnRenamed("id", "doc_id")
    wanted = rows.filter("doc_id % 500 = 3").select(F.col("doc_id").alias("doc"))
    kept = J._Marks.of(wanted, "doc", 200_000).on(rows, "doc_id", "to").filter("to")
    assert kept.filter("doc_id % 500 = 3").count() == 400
    assert kept.count() < 1.25 * 400


def test_only_crowded_documents_are_cut_into_combinations(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join(words[:50] + [f"x{i % 40}y{i}"]) for i in range(60)]
    apart = [" ".join(f"y{i}z{j}" for j in range(8)) for i in range(20_000)]
    docs = spark.createDataFrame(list(enumerate(near + apart)), "doc_id long, text string")
    asked, own = [], J._combinations
    monkeypatch.setattr(J, "_combinations", lambda texts, like: asked.append(texts.count()) or own(texts, like))
    found = J.classes(docs)
    assert found.filter("component_id = 0").count() == 60 and asked and 60 <= asked[0] <= 66


def test_false_marks_change_no_component(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:50] + [f"x{i % 9}"]) for i in range(60)] + [" ".join(f"y{i}z{j}" for j in range(30)) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0])], "doc_id long, text string")
    want = J.classes(docs).collect()
    monkeypatch.setattr(J, "MOST_MARKS", 2)  # nearly every id is marked
    assert sorted(J.classes(docs).collect(), key=str) == sorted(want, key=str)


def test_lists_in_several_components_are_joined_once(spark, monkeypatch):
    """One join by key finds the lists to compare and their largest components."""
    like, docs = J.Likeness(), range(6)
    hot = spark.createDataFrame([(1, d, [0]) for d in docs] + [(2, d, [0]) for d in (0, 1)], "key long, doc long, leaders array<long>")
    comps = spark.createDataFrame([(d, 0) for d in (0, 1, 2, 3)], "node long, component long")
    reps = spark.createDataFrame([(d, 10, [0] * (J.SKETCH_BITS // 64)) for d in docs], "doc_id long, n_shingles long, sketch array<long>")
    joins = []
    join = type(hot).join
    monkeypatch.setattr(type(hot), "join", lambda self, other, on=None, how=None: joins.append(str(on)) or join(self, other, on, how))
    pairs = {(x.a, x.b) for x in J._left_open(hot, comps, reps, like).collect()}
    assert pairs == {(a, b) for a in docs for b in (4, 5) if a < b}
    assert sum("key = k" in on for on in joins) + sum("(key, k)" in on for on in joins) == 1, joins
