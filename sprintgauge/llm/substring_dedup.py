"""Repeated word windows across documents by level-wise doubling.

To find windows of ``length`` words that also start in a document of smaller id,
lengths double from ``first`` up (13, 25, 50). At each level a candidate window is
stood for by one sub-window of the level's length, the one of least hash inside it:
equal windows choose equal sub-windows, so what repeats at the full length repeats at
every level, and few sub-windows are shuffled (about 2 in ``length - level``
places). Only candidates whose sub-window was seen in another document are extended
to the next length; at the last the sub-window is the window itself. The levels end
when no candidates survive.

Copies of a whole text are taken out first: the least id of a class stands for all,
and every word of the others is covered when they have ``length`` words.

Defined results: a null text has no words; windows that repeat only inside one
document stay; rows of the same id are one document; rows with a null id are
returned whole; an empty table gives no rows. Only the id and text columns are read.
Windows are compared by 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from . import words as W

LENGTH, FIRST = 50, 13


def levels(length: int = LENGTH, first: int = FIRST) -> list[int]:
    """Window lengths from about ``first`` to ``length``, each at most double the one before."""
    out = [length]
    while out[0] > first:
        out.insert(0, -(-out[0] // 2))
    return out


def _slide_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value (leftmost of equals) among ``values[i:i + width]``, per i."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, reach = np.arange(len(values)), 1
    while reach * 2 <= width:  # the least of twice the reach from two halves
        a, b = best[:-reach], best[reach:]
        best = np.where(values[b] < values[a], b, a)
        reach *= 2
    a, b = best[:n], best[width - reach:width - reach + n]
    return np.where(values[b] < values[a], b, a)


def _stand_ins(w: W.Words, level: int, length: int, kept: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, place, start)`` for each candidate window start.

    ``kept`` marks the starts that are still candidates; None means all.
    """
    whole = W.windows(w, length)[1]
    starts = np.flatnonzero(whole if kept is None else whole & kept)
    hashes, _ = W.windows(w, level)
    if level == length:
        return hashes[starts], starts, starts
    place = _slide_least(hashes, length - level + 1)[starts]
    return hashes[place], place, starts


def _rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text, tie``: ``tie`` tells texts of one id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))


def summaries(rows: DataFrame) -> DataFrame:
    """``doc_id, tie, n_words, class, sha``: size, word-sequence hash and sha256 of all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, w in W.slices(batch):
                some = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("tie"), pa.array(np.diff(w.first)),
                     pa.array(W.wholes(w).view(np.int64)),
                     pa.array(_digests(w, np.ones(len(w.hashes), dtype=bool)))],
                    ["doc_id", "tie", "n_words", "class", "sha"])

    return rows.mapInArrow(run, "doc_id long, tie long, n_words long, class long, sha string")


def _digests(w: W.Words, keep: np.ndarray) -> list[str]:
    """sha256 of the kept words of each text, joined by one space."""
    text = W.texts_of(w)[keep]
    start, size = w.start[keep], (w.stop - w.start)[keep]
    joined = np.append(w.data, np.uint8(32))
    # One byte more per word, for the space; the last of a text is cut off again.
    index = W.ragged(start, size + 1)
    ends = np.cumsum(size + 1)
    if len(index):
        index[ends - 1] = len(w.data)
    out = joined[index]
    last = np.concatenate([[0], ends])[np.searchsorted(text, np.arange(len(w.first) - 1), "right")]
    first = np.concatenate([[0], last[:-1]])
    view = memoryview(np.ascontiguousarray(out))
    return [hashlib.sha256(view[a:max(b - 1, a)]).hexdigest() for a, b in zip(first.tolist(), last.tolist())]


def _first_level(rows: DataFrame, level: int, length: int) -> DataFrame:
    """``hash, class, place`` of the first level's sub-windows of all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w in W.slices(batch):
                hashes, place, _ = _stand_ins(w, level, length, None)
                place, at = np.unique(place, return_index=True)
                text = W.texts_of(w)[place]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[at].view(np.int64)), pa.array(W.wholes(w)[text].view(np.int64)),
                     pa.array((place - w.first[text]).astype(np.int32))], ["hash", "class", "place"])

    return rows.filter("doc_id IS NOT NULL").select("text").mapInArrow(run, "hash long, class long, place int")


def _places(batch: pa.RecordBatch, begin: int, end: int, w: W.Words, column: str) -> np.ndarray:
    """Marks the words at the listed places of each text."""
    lists = batch.column(column).slice(begin, end - begin)
    marked = np.zeros(len(w.hashes), dtype=bool)
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy()[offsets[0]:offsets[-1]]
    marked[values + np.repeat(w.first[:-1], np.diff(offsets))] = True
    return marked


def _next_level(rows: DataFrame, before: int, level: int, length: int) -> DataFrame:
    """Sub-windows of ``level`` words of the windows whose shorter ones repeat.

    ``rows``: ``doc_id, class, text, places``; the places are those of repeated
    sub-windows of ``before`` words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, classes = batch.column("doc_id").to_numpy(), batch.column("class").to_numpy()
            for begin, end, w in W.slices(batch):
                marked = _places(batch, begin, end, w, "places")
                _, place, starts = _stand_ins(w, before, length, None)
                kept = np.zeros(len(w.hashes), dtype=bool)
                kept[starts] = marked[place]
                hashes, place, _ = _stand_ins(w, level, length, kept)
                place, at = np.unique(place, return_index=True)
                text = W.texts_of(w)[place]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[at].view(np.int64)), pa.array(classes[begin + text]),
                     pa.array((place - w.first[text]).astype(np.int32)), pa.array(ids[begin + text])],
                    ["hash", "class", "place", "doc_id"])

    return rows.select("doc_id", "class", "text", "places").mapInArrow(
        run, "hash long, class long, place int, doc_id long")


def _listed(rows: DataFrame) -> DataFrame:
    """``class, places``: sorted distinct places, at most as many as a text has words."""
    return rows.groupBy("class").agg(F.array_sort(F.collect_set("place")).alias("places"))


def _removed(rows: DataFrame, length: int) -> DataFrame:
    """``doc_id, tie, n_removed, sha`` after the windows at ``places`` are cut out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, w in W.slices(batch):
                marked = _places(batch, begin, end, w, "places")
                step = np.zeros(len(marked) + 1, dtype=np.int64)
                at = np.flatnonzero(marked)
                np.add.at(step, at, 1)
                np.add.at(step, at + length, -1)
                gone = np.cumsum(step)[:-1] > 0
                text = W.texts_of(w)
                some = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [some.column("class"), pa.array(np.bincount(text[gone], minlength=end - begin)),
                     pa.array(_digests(w, ~gone))], ["class", "n_removed", "sha"])

    return rows.select("class", "text", "places").mapInArrow(run, "class long, n_removed long, sha string")


def dedup(docs: DataFrame, length: int = LENGTH, first: int = FIRST) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row of ``docs``."""
    rows = _rows(docs)
    all_rows = stage(summaries(rows), "substring-summaries")
    known = all_rows.filter("doc_id IS NOT NULL")
    owner = known.groupBy("class").agg(F.min(F.struct("doc_id", "tie")).alias("least")).select(
        "class", F.col("least.doc_id").alias("owner"), F.col("least.tie").alias("owner_tie"))
    owner = stage(owner, "substring-classes")

    steps = levels(length, first)
    found = _first_level(rows, steps[0], length)
    # Seen in two different texts; copies of one text count once.
    seen = found.groupBy("hash").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi")
    places = _listed(found.join(seen.select("hash"), "hash"))
    # The text of each class that survives, at its least document.
    wanted = places.join(owner, "class").withColumnsRenamed({"owner": "doc_id", "owner_tie": "tie"})
    texts = rows.join(wanted, ["doc_id", "tie"])
    texts = stage(texts.select("doc_id", "class", "text", "places"), "substring-texts")
    level_rows = texts
    for before, level in zip(steps, steps[1:]):
        found = stage(_next_level(level_rows, before, level, length), "substring-level")
        seen = found.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi")
        again = found.join(seen, "hash")
        if level == length:
            again = again.filter("lo < doc_id")
        places = stage(_listed(again), "substring-places")
        level_rows = texts.drop("places").join(places, "class")
    if len(steps) == 1:
        raise ValueError("the first length must be below the window length")
    cut = _removed(level_rows, length).dropDuplicates()  # repeated rows of one text
    joined = all_rows.join(owner, "class", "left").join(
        stage(cut, "substring-cut").withColumnsRenamed({"class": "c", "sha": "cut_sha"}),
        F.col("class") == F.col("c"), "left")
    is_copy = (F.col("doc_id") > F.col("owner")) & (F.col("n_words") >= length)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    is_owner = F.col("doc_id") == F.col("owner")
    return joined.select(
        "doc_id", "n_words",
        F.when(is_copy, F.col("n_words")).when(is_owner, F.coalesce("n_removed", F.lit(0))).otherwise(0)
        .cast("long").alias("n_removed"),
        F.when(is_copy, empty).when(is_owner, F.coalesce("cut_sha", "sha")).otherwise(F.col("sha")).alias("kept_sha256"))
