"""Groups of spelling variants by a dictionary of trie-node pairs.

A word is a path in the trie of all words and, read backwards, in the reversed trie.
Every node has a 64-bit number made of its path (a sum over the path's letters and
depths), so numbering needs neither a join nor a walk from the driver. A word of
``L`` code points gives

* ``L`` *skip* pairs: (node before position i, reversed node after position i), and
* ``L + 1`` *split* pairs: (node before i, reversed node from i on).

Words that differ in one replaced code point share exactly one skip pair. Leaving one
code point of a word out gives another exactly where a skip pair of the first is a
split pair of the second; of a run of equal code points only the first skip counts,
so each neighbour is found once. A pair holds one word per letter of the alphabet at
most, and one split: what meets in a group is bounded by the alphabet, and only
counts and the best neighbour leave it, never pairs of words.

A word's form is its near word of largest count if that is ``FACTOR`` times its own.
Counts grow by that factor along a chain of forms, so chains are short and pointer
doubling finds their roots in a few joins.

Defined results: a null text has no words; a null doc_id counts as empty in the hash
that picks slips; repeated rows count each; words of any length are taken, in time
and memory linear in it; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from . import words as W

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, FACTOR, SLIP = 7, 2, 10, 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT, FIRST_SKIP, SKIP = 0, 1, 2
#: Words whose pairs are made at a time in a task.
_WORDS_AT_ONCE = 4096
_FORWARD, _BACKWARD = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _slipped(doc_id: Column, run: Column, slip: int) -> Column:
    """``run`` without one code point where ``slip`` divides the crc32 of id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run).cast("long")).cast("int")
    return F.when(h % slip == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
               slip: int = SLIP) -> DataFrame:
    """``word, n`` over whole texts, slips included; counted map-side before the shuffle."""
    # A shorter run cannot give a word long enough.
    runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    rows = docs.select("doc_id", F.explode(runs).alias("run"))
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    made = rows.select("doc_id", low.alias("run")).select(_slipped(F.col("doc_id"), F.col("run"), slip).alias("word"))
    return made.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= least_count)


def _node_sums(code: np.ndarray, depth: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Running sums of a pseudo-random number per (code point, depth), a zero first."""
    out = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum(W.mix(W.mix(depth.astype(np.uint64) + salt) + code.astype(np.uint64)), out=out[1:])
    return out


def _pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(word, prefix node, suffix node, kind)`` of all skip and split pairs of some words."""
    strings = texts.to_pylist()
    code = np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32)
    size = np.array([len(s) for s in strings], dtype=np.int64)
    stop = np.cumsum(size)
    start = stop - size
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(code))
    forward = _node_sums(code, place - start[word], _FORWARD)
    backward = _node_sums(code, stop[word] - place, _BACKWARD)
    before = lambda i, w: forward[i] - forward[start[w]]
    after = lambda i, w: backward[stop[w]] - backward[i]
    first = np.ones(len(code), dtype=bool)
    first[1:] = (code[1:] != code[:-1]) | (word[1:] != word[:-1])
    cut = W.ragged(start, size + 1)
    cut_word = np.repeat(np.arange(len(size)), size + 1)
    return (np.concatenate([word, cut_word]),
            np.concatenate([before(place, word), before(cut, cut_word)]),
            np.concatenate([after(place + 1, word), after(cut, cut_word)]),
            np.concatenate([np.where(first, FIRST_SKIP, SKIP), np.full(len(cut), SPLIT)]).astype(np.int8))


def node_pairs(words: DataFrame) -> DataFrame:
    """``prefix, suffix, id, n, kind``: the dictionary of trie-node pairs of ``id, word, n``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, _WORDS_AT_ONCE):
                some = batch.slice(begin, _WORDS_AT_ONCE)
                word, prefix, suffix, kind = _pairs(some.column("word"))
                take = lambda c: some.column(c).to_numpy()[word]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefix.view(np.int64)), pa.array(suffix.view(np.int64)), pa.array(take("id")),
                     pa.array(take("n")), pa.array(kind)], ["prefix", "suffix", "id", "n", "kind"])

    return words.select("id", "word", "n").mapInArrow(run, "prefix long, suffix long, id long, n long, kind byte")


def _neighbours(words: DataFrame) -> DataFrame:
    """``id, n_near, best``: how many near words and the best of them, ``(n, -id)``."""
    groups = node_pairs(words).groupBy("prefix", "suffix").agg(
        F.collect_list(F.struct("n", (-F.col("id")).alias("minus"), "kind")).alias("m")).filter(F.size("m") > 1)
    skips = F.sort_array(F.filter("m", lambda x: x["kind"] != SPLIT), asc=False)
    groups = groups.select(skips.alias("skips"), F.get(F.filter("m", lambda x: x["kind"] == SPLIT), F.lit(0)).alias("split"))
    groups = groups.select("*", F.filter("skips", lambda x: x["kind"] == FIRST_SKIP).alias("firsts"))
    worth = lambda x: F.when(x.isNotNull(), F.struct(x["n"].alias("n"), x["minus"].alias("minus")))

    def of_skip(x: Column) -> Column:
        meets_split = (x["kind"] == FIRST_SKIP) & F.col("split").isNotNull()
        other = F.when(F.get("skips", F.lit(0))["minus"] == x["minus"], worth(F.get("skips", F.lit(1)))).otherwise(
            worth(F.get("skips", F.lit(0))))
        return F.struct(
            (-x["minus"]).alias("id"),
            (F.size("skips") - 1 + meets_split.cast("int")).cast("long").alias("near"),
            F.greatest(other, F.when(meets_split, worth(F.col("split")))).alias("best"))

    of_split = F.struct((-F.col("split.minus")).alias("id"), F.size("firsts").cast("long").alias("near"),
                        worth(F.get("firsts", F.lit(0))).alias("best"))
    out = F.concat(F.transform("skips", of_skip), F.when(F.col("split").isNotNull(), F.array(of_split)).otherwise(F.array()))
    rows = groups.select(F.explode(out).alias("r")).select("r.*").filter("near > 0")
    return rows.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``id, root`` for each row of ``id, form``: pointers are doubled until none moves."""
    now = forms.select("id", F.col("form").alias("root"))
    while True:
        step = now.select(F.col("id").alias("at"), F.col("root").alias("next"))
        now = stage(now.join(step, F.col("root") == F.col("at"), "left").select(
            "id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not now.filter("moved").limit(1).count():
            return now.select("id", "root")
        now = now.drop("moved")


def groups(docs: DataFrame, factor: int = FACTOR, **kwargs: int) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of :func:`vocabulary`."""
    # Numbered in code-point order, so the lesser number is the lesser word.
    words = vocabulary(docs, **kwargs).orderBy("word").withColumn("id", F.monotonically_increasing_id())
    words = stage(words, "spelling-words")
    near = words.join(_neighbours(words), "id", "left")
    enough = F.col("best.n") >= factor * F.col("n")
    known = stage(near.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, -F.col("best.minus")).alias("form"), F.when(enough, F.col("best.n")).alias("form_n")), "spelling-near")
    linked = known.filter("form IS NOT NULL").select("id", "form")
    ends = _roots(linked).join(linked, "id")
    names = words.select(F.col("id").alias("i"), F.col("word").alias("name"))
    ends = ends.join(names.withColumnsRenamed({"i": "form", "name": "form_word"}), "form")
    ends = ends.join(names.withColumnsRenamed({"i": "root", "name": "root_word"}), "root").select("id", "form_word", "root_word")
    return known.join(ends, "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
