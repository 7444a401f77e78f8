"""The frequency order of tokens: right classes, and no link lost whatever they are."""

import random

import numpy as np
import pyarrow as pa

from sprintgauge.llm import jaccard_join, words

LIKE = jaccard_join.Likeness(3, 90)


def tokens(text, classes=None):
    data, offsets = words.column(pa.RecordBatch.from_arrays([pa.array([text])], ["text"]), "text")
    return jaccard_join._sets(words.find(data, offsets, lower=True), LIKE.width, classes)[1]


def test_frequent_tokens_come_last(spark):
    common = "please read these terms"
    texts = [f"a{i} b{i} c{i} {common}" for i in range(300)] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    classes = jaccard_join.frequency_classes(docs, LIKE)
    assert len(classes) == jaccard_join.COUNTERS
    shared = tokens(common)
    assert (classes[jaccard_join._counter(shared, len(classes))] > 0).all()
    assert np.count_nonzero(classes) == len(shared)
    ordered = tokens(texts[5], classes)
    assert (np.diff(ordered >> np.uint64(60)) >= 0).all()
    assert (ordered[-len(shared):] >> np.uint64(60) > 0).all() and (ordered[:-len(shared)] >> np.uint64(60) == 0).all()


def test_no_documents_no_classes(spark):
    assert not jaccard_join.frequency_classes(spark.createDataFrame([], "doc_id long, text string"), LIKE).any()


def test_crowded_counters_lose_no_link(spark, monkeypatch):
    """With 64 counters every class is wrong; components are still those of all pairs."""
    monkeypatch.setattr(jaccard_join, "COUNTERS", 64)
    monkeypatch.setattr(jaccard_join, "RARE", 4)
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(80)}" for _ in range(70)]
        for _ in range(rng.choice((1, 2, 8))):
            texts.append(" ".join(base))
            base[rng.randrange(len(base))] = f"w{rng.randrange(80)}"
    sets = [set(tokens(t).tolist()) for t in texts]
    least = list(range(len(texts)))
    for _ in texts:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if 100 * len(x & y) >= 90 * len(x | y):
                    least[i] = min(least[i], least[j])
    got = jaccard_join.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), LIKE).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(least))


def test_counts_beyond_a_byte_in_one_task_are_whole(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "COUNTERS", 1 << 10)
    like = jaccard_join.Likeness(3, 90)
    docs = spark.createDataFrame([(i, f"a b c w{i} x{i}") for i in range(700)], "doc_id long, text string").coalesce(1)
    classes = jaccard_join.frequency_classes(docs, like)
    batch = pa.RecordBatch.from_arrays([pa.array(["a b c"])], ["text"])
    (_, _, found), = words.slices(batch)
    place = jaccard_join._counter(jaccard_join._sets(found, 3)[1], 1 << 10)[0]
    assert classes[place] == 1 + int(np.log2((2 ** (np.floor(8 * np.log2(701 + 1)) / 8) - 3) / 8)) and classes[place] == classes.max()


def test_a_document_meets_its_component_once_whatever_keys_it_has(spark, monkeypatch):
    """Under keys 1 to 9 are documents 1 to 6: 1 to 4 are one component, 5 and 6 are alone."""
    made, stage = {}, jaccard_join.stage
    monkeypatch.setattr(jaccard_join, "stage", lambda df, name: made.setdefault(name, df) and stage(df, name))
    hot = spark.createDataFrame([(k, d) for k in range(1, 10) for d in range(1, 7)] + [(10, 1), (10, 2)], "key long, doc long")
    comps = spark.createDataFrame([(d, 1) for d in range(1, 5)], "node long, component long")
    reps = spark.createDataFrame([(d, 50, [0] * (jaccard_join.SKETCH_BITS // 64)) for d in range(1, 7)],
                                 "doc_id long, n_shingles long, sketch array<long>")
    got = jaccard_join._left_open(hot, comps, reps, jaccard_join.Likeness(3, 90)).collect()
    assert sorted((r.a, r.b) for r in got) == [(a, b) for a in range(1, 7) for b in (5, 6) if a < b]
    plan = made["jaccard-apart"]._jdf.queryExecution().optimizedPlan().toString()
    assert any("Aggregate [doc" in line for line in plan[plan.index("Join LeftOuter"):].splitlines()[1:4])
    assert {r.key for r in made["jaccard-apart"].collect()} == set(range(1, 10))
