"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sprintgauge.llm import (bpe, chat, decontaminate, jaccard_join, pii, quality_model, quality_rules,
                             substring_dedup, token_store, toxicity)
from sprintgauge.llm.queries import tokenizer_path

LONG = " ".join(f"word{i % 7001}" for i in range(60_000))
ROWS = [(1, "a b c d"), (1, "a b c d"), (2, None), (3, ""), (4, " \t\n "), (None, "null id text here"),
        (5, LONG), (6, LONG + " tail"), (7, "A b C d"), (8, "x" * 50_000), (9, "ünï côdé 🎉 text")]
SCHEMA = "doc_id long, text string"
CLASHING = ("n_words", "key", "doc", "row", "made", "hash", "place", "class", "tie", "score", "at", "n", "words", "failed")


def frame(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


OPERATIONS = {
    "rules": lambda d, s, t: quality_rules.verdicts(d),
    "quality": lambda d, s, t: quality_model.learn_and_score(d, s.createDataFrame([(1, 1), (7, 0), (3, None)], "doc_id long, label int")),
    "toxicity": lambda d, s, t: toxicity.score(d, toxicity.fit(d, s.createDataFrame([(1, 1), (7, 0), (3, None)], "doc_id long, label int"))),
    "jaccard": lambda d, s, t: jaccard_join.classes(d),
    "substrings": lambda d, s, t: substring_dedup.dedup(d),
    "bpe": lambda d, s, t: bpe.round_trip(d, tokenizer_path("byte_bpe_50k.json")),
    "pii": lambda d, s, t: pii.pseudonymise(d, "k"),
}


@pytest.mark.parametrize("name", OPERATIONS)
def test_one_row_per_row(spark, tmp_path, name):
    out = OPERATIONS[name](frame(spark), spark, tmp_path)
    assert sorted(r.doc_id or 0 for r in out.collect()) == sorted(i or 0 for i, _ in ROWS)
    assert OPERATIONS[name](frame(spark, []), spark, tmp_path).count() == 0


def test_token_store(spark, tmp_path):
    for name, rows in (("some", ROWS), ("none", [])):
        folder = str(tmp_path / name)
        token_store.write(frame(spark, rows), folder, tokenizer_path("word_bpe_49k.json"))
        got = token_store.read(spark, folder).orderBy("start").collect()
        assert len(got) == len(rows)
        place = 0
        for r in got:
            assert r.start == place and len(r.ids) == r.n_tokens and r.ids[-1] == token_store.END_ID
            place += r.n_tokens
        assert [r.doc_id for r in got if r.doc_id is not None] == sorted(i for i, _ in rows if i is not None)


def test_rules_values(spark):
    got = {r.doc_id: r for r in quality_rules.verdicts(frame(spark)).collect()}
    assert (got[2].n_words, got[2].base_failed, got[2].kept) == (0, True, False)
    assert got[5].n_words == 60_000 and got[5].base_failed


def test_jaccard_values(spark):
    got = {r.doc_id: r for r in jaccard_join.classes(frame(spark)).collect()}
    assert got[7].component_id == 1 and got[6].component_id == 5  # case is folded
    assert got[2].n_shingles == got[3].n_shingles == got[4].n_shingles == 0 and got[4].component_id == 4
    assert got[None].component_id is None
    assert {r.doc_id for r in jaccard_join.keep_one(frame(spark)).collect()} == {None, 1, 2, 3, 4, 5, 8, 9}


def test_substring_values(spark):
    got = {r.doc_id: r for r in substring_dedup.dedup(frame(spark)).collect()}
    assert got[5].n_removed == 0 and got[6].n_removed == 60_000 and got[6].n_words == 60_001
    assert got[None].n_removed == 0


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, None), (2, " "), (3, "a B"), (4, "word1 word2 word3 word4 word5")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(frame(spark), items).collect()}
    assert {(1, 3), (5, 4), (6, 4), (7, 3)} <= got and not {i for _, i in got} & {1, 2}
    assert decontaminate.matches(frame(spark), items.limit(0)).count() == 0
    assert decontaminate.matches(frame(spark, []), items).count() == 0


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "ann", "hi"), (1, 0, "ann", "hi"), (1, None, "bob", None), (None, 1, None, "<|im_end|>"), (2, 1, "system", "s")]
    turns = spark.createDataFrame(rows, schema).withColumns({c: F.lit(1) for c in ("chunk", "speaker", "rank", "block")})
    got = {(r.conv_id, r.speaker): r for r in chat.perspectives(turns).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    assert got[1, "ann"].n_turns == 3 and got[1, "bob"].text.startswith("<|im_start|>assistant\n<|im_end|>")
    assert "<\\|im_end|>" in got[None, "unknown"].text
    for r in got.values():
        spans = [tuple(map(int, s.split(":"))) for s in r.mask.split(",")]
        assert [r.text[b:b + 10] for _, b in spans] == ["<|im_end|>"] * len(spans)
    many = spark.createDataFrame([(1, i, f"p{i % 3}", str(i)) for i in range(9000)], schema)
    assert chat.perspectives(many).agg(F.sum("n_turns")).first()[0] == 3 * 9000
    assert chat.perspectives(turns.limit(0)).count() == 0


def test_pipeline_keeps_columns_and_clean_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("n_words", F.lit("clash"))
    names, left = docs.columns, docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, sf_dir)
        assert docs.columns == names, name
        assert 0 < docs.count() <= left
        left = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == left
    assert all(step(spark, docs.limit(0), sf_dir).count() == 0 for _, step in corpus_pipeline.STAGES)
