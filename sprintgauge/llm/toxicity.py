"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are the set of its words, their stems (first ``STEM`` bytes),
neighbouring pairs and pairs with one word between, lower-cased and without
punctuation, hashed to ``DIMENSIONS`` places.
FTRL-proximal keeps a rate per coordinate and an L1 threshold, so most weights are
exactly zero. Shards of a bounded sample of labelled documents (equal rows once) are fitted side by side,
each by one task in passes over its rows, and their weights are averaged per
coordinate. The non-zero weights, never more than ``DIMENSIONS``, go to all tasks.

Defined results: a null text counts as an empty one and scores by the intercept
alone; rows with a null or repeated id are scored row by row; without labels the
score is 0.5; an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from . import words as W
from .sampling import bounded

DIMENSIONS = 1 << 20
#: Bound of the labelled rows that weights are fitted to, and of one shard.
SAMPLE_ROWS, SHARD_ROWS = 24_000, 6_000
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 20.0, 0.0, 8
#: Bytes of a word's stem, which stands beside the word itself.
STEM = 4
_KINDS = (np.uint64(0x51), np.uint64(0xA3), np.uint64(0xC7), np.uint64(0xE5))
_SHIFT = np.uint64(44)


def features(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """``(text, coordinate)`` of each n-gram and skip-gram, repeats included."""
    text, h = W.texts_of(w), w.hashes
    texts, places = [text, text], [W.mix(h + _KINDS[0]) >> _SHIFT, W.mix(W.stems(w, STEM) + _KINDS[3]) >> _SHIFT]
    for gap, kind in ((1, _KINDS[1]), (2, _KINDS[2])):
        if len(h) > gap:
            same = text[gap:] == text[:-gap]
            pair = W.mix(W.mix(h[:-gap] + kind) + h[gap:]) >> _SHIFT
            texts.append(text[:-gap][same])
            places.append(pair[same])
    return np.concatenate(texts), np.concatenate(places).astype(np.int64)


def _once(text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(text * DIMENSIONS + place)
    return key // DIMENSIONS, key % DIMENSIONS


def fit_shard(examples: list[np.ndarray], y: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and intercept from one shard; an example is its set of coordinates."""
    z, n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    bz = bn = bias = 0.0
    weights = lambda i: np.where(np.abs(z[i]) <= L1, 0.0, (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))
    for turn in range(passes):
        for k in np.random.default_rng(turn).permutation(len(y)):
            i = examples[k]
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = p - y[k]
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / ALPHA * w
            step = (np.sqrt(bn + g * g) - np.sqrt(bn)) / ALPHA
            bz, bn = bz + g - step * bias, bn + g * g
            bias = -bz / ((BETA + np.sqrt(bn)) / ALPHA)
    return weights(np.arange(DIMENSIONS)), bias


def _examples(batch: pa.RecordBatch) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for begin, end, found in W.slices(batch, lower=True, between=W.LETTERS_ONLY):
        text, place = _once(*features(found))
        out += np.split(place, np.searchsorted(text, np.arange(1, end - begin)))
    return out


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``place, weight`` of the coordinates that count; place -1 is the intercept."""
    known = labels.filter(F.col("label").isNotNull()).select("doc_id", F.col("label").cast("double").alias("label"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie"))
    # Sampled after the join: labels of other documents must not use up the bound.
    rows = bounded(texts.join(known, "doc_id"), sample_rows, ["doc_id", "label", "tie"])

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _examples(batch)
            places = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("tie"), batch.column("label"),
                 pa.ListArray.from_arrays(pa.array(places), pa.array(flat.astype(np.int32)))], ["doc_id", "tie", "label", "at"])

    examples = stage(rows.select("doc_id", "tie", "label", "text").mapInArrow(
        coordinates, "doc_id long, tie long, label double, at array<int>"), "toxicity-examples")
    shards = max(1, -(-examples.count() // SHARD_ROWS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "label", "tie"], ignore_index=True)
        weight, bias = fit_shard([np.asarray(a, dtype=np.int64) for a in pdf["at"]], pdf["label"].to_numpy())
        place = np.flatnonzero(weight)
        return pd.DataFrame({"place": np.append(place, -1), "weight": np.append(weight[place], bias)})

    parts = examples.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(shards)))
    parts = stage(parts.groupBy("shard").applyInPandas(run, "place long, weight double"), "toxicity-shards")
    # Shards without rows are none: each that was fitted has one intercept.
    fitted = max(1, parts.filter("place = -1").count())
    return parts.groupBy("place").agg((F.sum("weight") / F.lit(fitted)).alias("weight"))


def score(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """``doc_id, score`` of every whole text."""
    found = weights.toPandas()  # at most one row per coordinate
    table = np.zeros(DIMENSIONS)
    inner = found["place"] >= 0
    table[found.loc[inner, "place"]] = found.loc[inner, "weight"]
    bias = float(found.loc[~inner, "weight"].sum())
    place, weight = np.flatnonzero(table), table[table != 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(DIMENSIONS)
        dense[place] = weight
        for batch in batches:
            for begin, end, found in W.slices(batch, lower=True, between=W.LETTERS_ONLY):
                text, at = features(found)
                counts = dense[at] != 0
                text, at = _once(text[counts], at[counts])
                total = bias + np.bincount(text, weights=dense[at], minlength=end - begin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, end - begin),
                     pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")
