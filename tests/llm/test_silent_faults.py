"""Inputs on which results were once wrong without a sign of it."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sprintgauge.llm import jaccard_join, pii, queries, sampling, substring_dedup, token_store, toxicity, words

SCHEMA = "doc_id long, text string"
WORDS, BYTES = queries.tokenizer_path("word_bpe_49k.json"), queries.tokenizer_path("byte_bpe_50k.json")


def thue_morse(letters, bits=10):
    return "".join(letters[bin(i).count("1") % 2] for i in range(1 << bits))


def test_structured_words_have_different_hashes():
    pairs = [thue_morse("ab"), thue_morse("ba"), " ".join(thue_morse("ab")), " ".join(thue_morse("ba"))]
    (_, _, w), = words.slices(pa.RecordBatch.from_arrays([pa.array(pairs)], ["text"]))
    whole = words.wholes(w)
    assert w.hashes[0] != w.hashes[1] and len({int(h) for h in whole}) == 4
    long, inside = words.windows(w, 1024)
    assert long[inside].tolist() and len(set(long[inside].tolist())) == inside.sum()


def test_windows_are_hashed_by_their_words():
    rng = random.Random(0)
    text = " ".join(rng.choice("abc") for _ in range(400))
    for length in (1, 2, 3, 5, 13, 25, 50):
        (_, _, w), = words.slices(pa.RecordBatch.from_arrays([pa.array([text, text[10:]])], ["text"]))
        hashes, inside = words.windows(w, length)
        of = {}
        flat = text.split() + text[10:].split()
        for i in np.flatnonzero(inside):
            of.setdefault(tuple(flat[i:i + length]), set()).add(int(hashes[i]))
        assert all(len(h) == 1 for h in of.values()) and len({h for s in of.values() for h in s}) == len(of)


def test_one_different_word_is_seen(spark):
    filler = [f"w{i}" for i in range(60)]
    texts = []
    for letters in ("ab", "ba"):
        filler[30] = thue_morse(letters)
        texts.append(" ".join(filler))
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert [r.n_removed for r in substring_dedup.dedup(docs).orderBy("doc_id").collect()] == [0, 0]
    short = spark.createDataFrame([(1, f"{thue_morse('ab')} x y"), (2, f"{thue_morse('ba')} x y")], SCHEMA)
    got = jaccard_join.classes(short, jaccard_join.Likeness(3, 90)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2}


def odd_texts(n=3000):
    rng = random.Random(4)
    letters = "aZé İıŞşŉǰß.,'!?0 5\nKkΣσ"
    return ["AKBANKİ. x", "İ.", "aİ,b İ,"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_token_store_ids_and_checksums_equal_the_library(spark, tmp_path):
    library, texts = Tokenizer.from_file(WORDS), odd_texts()
    ids = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    encoder = token_store.PieceEncoder(WORDS)
    assert [np.frombuffer(encoder.encode(t), "<u4").tolist() for t in texts] == ids
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], SCHEMA)
    folder = str(tmp_path / "tokens")
    token_store.write(docs, folder, WORDS, partitions=3)
    want, start = {}, 0
    for i, own in [(-1, []), *enumerate(ids)]:
        data = np.array([*own, 1], dtype="<u4").tobytes()
        want[i] = (start, len(own) + 1, zlib.crc32(data))
        start += len(own) + 1
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.checksums(token_store.read(spark, folder)).collect()}
    assert got == want


def test_byte_pairs_round_trip_equals_the_library(spark):
    from sprintgauge.llm import bpe

    library, texts = Tokenizer.from_file(BYTES), odd_texts(400)
    got = {r.doc_id: r for r in bpe.round_trip(spark.createDataFrame(list(enumerate(texts)), SCHEMA), BYTES).collect()}
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        data = np.array(e.ids, dtype="<u4").tobytes()
        text = library.decode(e.ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (
            len(e.ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("text", ["a@b" + ".c" * 500_000, "1" * 1_000_000, "2020-01-" * 20_000])
def test_long_runs_of_a_pattern_end(spark, text):
    got = pii.pseudonymise(spark.createDataFrame([(1, text), (2, "mail bob.1@x.org now")], SCHEMA), "k").orderBy("doc_id").collect()
    assert got[1].n_pseudonyms == 1 and got[1].text.endswith("@x.org now") and got[0].text is not None


def test_labels_of_other_documents_do_not_use_up_the_sample(spark):
    docs = spark.createDataFrame([(i, f"good day number{i}" if i % 2 else f"vile rotten scum{i}") for i in range(400)], SCHEMA)
    own = spark.range(400).selectExpr("id AS doc_id", "CAST(id % 2 = 0 AS INT) AS label")
    more = own.unionByName(spark.range(1000, 300_000).selectExpr("id AS doc_id", "0 AS label"))
    weights = lambda labels: {r.place: round(r.weight, 9) for r in toxicity.fit(docs, labels).collect()}
    assert weights(own) == weights(more) and len(weights(own)) > 5


def test_repeated_rows_cannot_fill_a_sample(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS doc_id", "'t' AS text")
    got = sampling.bounded(rows, 100_000, ["doc_id", "text"])
    assert got.count() == rows.distinct().count()


def test_any_column_name_passes_through(spark, sf_dir):
    docs = spark.createDataFrame([(1, "call (415) 555-2671 x y z"), (2, "a b c d e f g"), (3, "a b c d e f g")], SCHEMA)
    names = ("gone", "__gone", "__leak", "leak", "row", "made", "doc", "n_pseudonyms", "__pseudonyms", "node", "component")
    docs = docs.withColumns({c: F.lit("mine") for c in names})
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    for step in (corpus_pipeline.decontaminated, corpus_pipeline.pseudonymised):
        out = step(spark, docs, sf_dir)
        assert out.columns == docs.columns and all(r[c] == "mine" for r in out.collect() for c in names)
    assert corpus_pipeline.pseudonymised(spark, docs, sf_dir).filter("doc_id = 1").first().text != "call (415) 555-2671 x y z"
    with pytest.raises(ValueError, match="n_pseudonyms"):
        pii.pseudonymise(docs, "k")


def test_dialogues_of_many_turns_follow_the_sql_rule(spark):
    from sprintgauge.llm import chat

    rows = [(1, i, "a b" if i < 70 else "c", f"t{i}") for i in range(130)]
    got = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.chunk, r.speaker) for r in got} == {(c, s) for c in range(3) for s in ("a\\sb", "c")}


def test_token_store_looks_up_a_word_once_whatever_case_and_marks():
    texts = ["word Word. WORD,## wordé WORDÉ. ÀÇ÷. É×.", "<|ENDOFTEXT|>. a<|endoftext|>A. T̈. İ. x... 'S. It'S,", "", " .", "é. ß###"]
    encoder = token_store.PieceEncoder(WORDS)
    made, make = [], encoder.make
    encoder.make = lambda piece: made.append(piece) or make(piece)
    ids, sizes = encoder.encode_all(pa.array(texts))
    expected = [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [token_store.END_ID] for t in texts]
    assert ids.tolist() == sum(expected, []) and sizes.tolist() == [len(e) for e in expected]
    assert [p for p in made if p.lower().startswith("word")] == ["word", "wordé"]
