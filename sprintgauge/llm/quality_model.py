"""A quality score from document statistics by histogram gradient-boosted trees.

Statistics of every whole text are computed once, per Arrow batch in numpy. Trees are
fitted to a bounded sample of labelled rows (``SAMPLE_ROWS``): values are binned by
quantiles, each level of a tree needs one histogram of gradients per statistic. All
trees are complete binary trees in flat arrays, so scoring a batch is a few indexed
steps over all rows at once, with no branch per row.

Defined results: a null text counts as an empty one; an empty text has a score like
any other; rows with a null or repeated id are scored row by row; rows without a
label, or with a null one, are not learnt; without any label the score is 0.5; an
empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from . import words as W
from .sampling import bounded

#: Bound of the labelled rows that trees are fitted to.
SAMPLE_ROWS = 40_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, L2 = 80, 4, 0.15, 64, 20, 1.0

_CLASSES = {
    "upper": [*range(65, 91)], "digit": [*range(48, 58)], "comma_stop": [44, 46],
    "exclaim": [33], "mark": [35, 36, 37, 38, 42, 60, 62, 124], "other_punct": [34, 39, 40, 41, 45, 47, 58, 59, 61, 63, 64, 91, 92, 93, 95, 123, 125],
    "high": [*range(128, 256)], "line": [10],
}
STATISTICS = [
    "log_words", "log_bytes", "mean_word", "long_words", "distinct_words", "top_word",
    "word_repeats", "distinct_pairs", "distinct_lines", "words_per_line", *(f"share_{c}" for c in _CLASSES),
]


def _distinct(text: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the number of distinct values and the count of the commonest."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(value)))
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, text[at], counts)
    return np.bincount(text[at], minlength=n), top


def _statistics(w: W.Words, offsets: np.ndarray) -> np.ndarray:
    n = len(w.first) - 1
    size = np.diff(offsets)
    count = np.diff(w.first)
    text = W.texts_of(w)
    length = w.stop - w.start
    some, many = np.maximum(count, 1), np.maximum(size, 1)
    per_text = lambda x: np.bincount(text, weights=x, minlength=n)
    distinct, top = _distinct(text, w.hashes, n)
    pair = W.windows(w, 2)
    pairs, _ = _distinct(text[pair[1]], pair[0][pair[1]], n)
    again = np.zeros(len(w.hashes), dtype=bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (text[1:] == text[:-1])
    # Lines with a word: each begins at a word before which a line feed (or nothing) stands.
    feeds = np.concatenate([[0], np.cumsum(w.data == 10)])
    line = feeds[w.start]
    begins = np.ones(len(line), dtype=bool)
    begins[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(begins)
    mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(w.hashes), dtype=np.uint64)])
    sums = mixed[np.append(at[1:], len(line))] - mixed[at] if len(at) else mixed[:0]
    lines = np.bincount(text[at], minlength=n)
    distinct_lines, _ = _distinct(text[at], sums, n)
    columns = [
        np.log1p(count), np.log1p(size), per_text(length) / some, per_text(length > 15) / some,
        distinct / some, top / some, per_text(again) / some, pairs / some,
        distinct_lines / np.maximum(lines, 1), count / np.maximum(lines, 1),
    ]
    for members in _CLASSES.values():
        member = np.zeros(256, dtype=bool)
        member[members] = True
        run = np.concatenate([[0], np.cumsum(member[w.data], dtype=np.int64)])
        columns.append((run[offsets[1:]] - run[offsets[:-1]]) / many)
    return np.column_stack(columns).astype(np.float32)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``x``, the statistics of each whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = W.column(batch, "text")
            for begin, end, found in W.slices(batch):
                x = _statistics(found, (offsets[begin:end + 1] - offsets[begin]).astype(np.int64))
                places = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, end - begin),
                     pa.ListArray.from_arrays(pa.array(places), pa.array(x.ravel()))], ["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, x array<float>")


class Trees(NamedTuple):
    """Complete trees: node ``k`` has children ``2k + 1`` and ``2k + 2``; leaves come last."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boosted trees for a 0/1 label by Newton steps on the logistic loss."""
    n, width = x.shape if len(x) else (0, len(STATISTICS))
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature = np.zeros((trees, inner), dtype=np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    if not n or y.min() == y.max():
        share = (y.sum() + 0.5) / (n + 1) if n else 0.5
        return Trees(float(np.log(share / (1 - share))), feature, threshold, leaf)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    total = np.full(n, base)
    gain_of = lambda g, h: g * g / (h + L2)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width_here = (1 << level) - 1, 1 << level
            best = np.full(width_here, 1e-9)
            for f in range(width):
                cell = (node - first) * BINS + binned[:, f]
                hist = [np.bincount(cell, weights=v, minlength=width_here * BINS).reshape(width_here, BINS)
                        for v in (grad, hess, np.ones(n))]
                g, h, c = (v.cumsum(axis=1)[:, :len(cuts[f])] for v in hist)
                ga, ha, ca = (v.sum(axis=1, keepdims=True) for v in hist)
                gain = gain_of(g, h) + gain_of(ga - g, ha - h) - gain_of(ga, ha)
                gain[(c < LEAST_ROWS) | (ca - c < LEAST_ROWS)] = 0
                if not gain.shape[1]:
                    continue
                at = gain.argmax(axis=1)
                value = gain[np.arange(width_here), at]
                better = value > best
                best[better] = value[better]
                feature[t, first:first + width_here][better] = f
                threshold[t, first:first + width_here][better] = cuts[f][at[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        place = node - inner
        g = np.bincount(place, weights=grad, minlength=leaves)
        h = np.bincount(place, weights=hess, minlength=leaves)
        leaf[t] = rate * g / (h + L2)
        total += leaf[t, place]
    return Trees(base, feature, threshold, leaf)


def score(rows: DataFrame, model: Trees) -> DataFrame:
    """``doc_id, score`` from ``doc_id, x``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").values.to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(STATISTICS)), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def learn_and_score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Scores of all ``docs`` by trees fitted to ``labels`` (``doc_id, label`` of 0 or 1)."""
    rows = stage(statistics(docs), "quality-statistics")
    known = labels.filter(F.col("label").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label"))
    # Rows go by id, so that the fit does not depend on how tasks were packed.
    sample = bounded(rows.join(known, "doc_id"), sample_rows, ["doc_id", "label", "x"]).orderBy("doc_id", "label", "x").toArrow()
    y = sample.column("label").to_numpy().astype(float)
    x = np.array(sample.column("x").to_pylist(), dtype=np.float32).reshape(len(y), len(STATISTICS))
    return score(rows, fit(x, y))
