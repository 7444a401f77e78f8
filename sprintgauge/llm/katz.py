"""Katz backoff language model with Good-Turing discounts and exact normalisation.

Tokens of a text are its words (ASCII capitals lowered) and one end mark; an
``order - 1`` fold begin mark is context only. For a gram seen ``c`` times after a
context seen ``t`` times

    P(word | context) = d(c) * c / t                      if the gram was seen
                      = backoff(context) * P(word | shorter context)   otherwise,

down to unigrams, whose discounted mass is the probability of any unknown word.
``d`` are Katz's discounts from the counts of counts up to ``K``; where those give no
proper discount, an absolute one takes their place. ``backoff`` is the mass the
discounts free over the mass the shorter context gives to words not seen here, so the
probabilities after each context add up to one. A context that no discount touches
frees the mass of one more occurrence.

Evaluation follows the recursion token by token. Written as sums, the log probability
of a token is that of its unigram, plus the backoff weight of each longer context, plus
for each seen gram what it gains over its backed-off value. So every gram has one
number: gain plus weight as a context. The numbers are joined to the grams of a text.

The model grows with the corpus: all grams are counted and kept, in tables partitioned
by ``part``; texts are scored one part after the other, which bounds the disk a
shuffle takes. Words that make up at least one in ``HEAD`` of all tokens (never more
than ``HEAD`` of them) have small codes and travel to every task; so do the numbers of
grams that are as frequent in training. No other gram that the model knows can crowd a task.

Defined results: a null or empty text is one end mark; rows of equal id and text score
alike, and rows of one id with different texts each get their own; a null id is scored
and is learnt from if the condition says so; no training rows give base and model the
probability 1 for unknown tokens only; an empty table gives no rows. Grams are told
apart by 63-bit hashes of their words. Only the id and text columns are read, and those
that the training condition names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import drop_stage, stage
from . import words as W

ORDER, K, HEAD, PARTS = 2, 5, 1 << 20, 2
#: Grams a task adds up or answers; there are as many tasks as tokens ask for.
TASK_ROWS = 1 << 22
_BEGIN, _END = np.uint64(0x42D4C957F2D5851F), np.uint64(0x7767814F14057B7E)
_TOP = np.uint64(1 << 63)
_SLICE = 4 << 20


class Places:
    """Where keys stand in a sorted list, by two direct tables; few keys are left to a search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = np.uint64((1 << max(4, (4 * len(keys)).bit_length())) - 1)
        self.tables, left = [], np.arange(len(keys))
        for shift in (np.uint64(11), np.uint64(37)):
            table = np.zeros(int(self.mask) + 1, dtype=np.int32)
            slot = (keys[left].view(np.uint64) >> shift & self.mask).astype(np.int64)
            table[slot] = left
            self.tables.append((shift, table))
            left = left[table[slot] != left]
        self.left, self.rest = left, keys[left]

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key is, and which keys are there."""
        at, found = np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=bool)
        if not len(self.keys):
            return at, found
        open_ = np.arange(len(key))
        for shift, table in self.tables:
            some = key[open_]
            place = table[(some.view(np.uint64) >> shift & self.mask).astype(np.int64)]
            hit = self.keys[place] == some
            at[open_[hit]], found[open_[hit]] = place[hit], True
            open_ = open_[~hit]
        if len(self.rest):
            place = np.minimum(np.searchsorted(self.rest, key[open_]), len(self.rest) - 1)
            hit = self.rest[place] == key[open_]
            at[open_[hit]], found[open_[hit]] = self.left[place[hit]], True
        return at, found


class Head(NamedTuple):
    """Sorted keys that every task has, and their numbers."""

    keys: np.ndarray
    values: np.ndarray


class _KnownHead:
    """A head in a task."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.find, self.values = Places(keys).find, values

    def sums(self, text: np.ndarray, key: np.ndarray, n_texts: int) -> np.ndarray:
        """Per text the sums of the numbers of its keys that are there."""
        at, found = self.find(key)
        return np.stack([np.bincount(text[found], weights=v[at[found]], minlength=n_texts) for v in self.values.T], axis=1)


class Model(NamedTuple):
    """``tokens`` and ``types`` seen in training; numbers of unigrams, and of longer grams per order.

    ``unigrams``: ``key, value, base, known`` less what an unknown word has;
    ``grams[i]``: a function of a part that gives ``ctx, low, value`` of order ``i + 2``.
    """

    order: int
    tokens: int
    types: int
    unknown: float
    unigrams: DataFrame
    grams: list
    codes: np.ndarray
    heads: list[Head]
    #: Tables that only scoring reads.
    staged: list[DataFrame]


def discounts(counts_of_counts: dict[int, int], k: int = K) -> list[float]:
    """``d(0), d(1), ..., d(k)``: what part of a count stays; beyond ``k`` all of it."""
    n = [counts_of_counts.get(r, 0) for r in range(k + 2)]
    if n[1] and all(n[1:]):
        common = (k + 1) * n[k + 1] / n[1]
        d = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if common != 1 else 0.0 for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return [1.0, *d]
    off = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    # A discount of a whole count would take a single occurrence away.
    return [1.0, *[1 - min(off, 0.75) / r for r in range(1, k + 1)]]


def _discounted(c: Column, d: list[float]) -> Column:
    share = F.get(F.array(*[F.lit(x) for x in d]), F.least(c, F.lit(len(d) - 1)).cast("int"))
    return F.when(c < len(d), share).otherwise(1.0) * c


def _sequence(w: W.Words, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with their marks, the text of each, and its place in the text's sequence."""
    counts = np.diff(w.first)
    sizes = counts + order
    stops = np.cumsum(sizes)
    tokens = np.full(int(stops[-1]) if len(stops) else 0, _BEGIN)
    tokens[W.ragged(stops - sizes + order - 1, counts)] = w.hashes
    tokens[stops - 1] = _END
    text = np.repeat(np.arange(len(counts)), sizes)
    return tokens, text, np.arange(len(tokens)) - (stops - sizes)[text]


def _codes(tokens: np.ndarray, codes: Places) -> np.ndarray:
    """Place among the frequent words, or the hash with its top bit set (negative as a long)."""
    tokens = tokens | _TOP
    at, found = codes.find(tokens)
    return np.where(found, at, tokens.view(np.int64))


def _pair(ctx: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (W.mix(W.mix(ctx.view(np.uint64)) + low.view(np.uint64)) | _TOP).view(np.int64)


def _part(ctx: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (ctx ^ low) & (PARTS - 1)


class _Grams(NamedTuple):
    text: np.ndarray
    ctx: np.ndarray
    low: np.ndarray
    key: np.ndarray


def _level(w: W.Words, order: int, codes: Places, level: int, contexts: bool = False) -> _Grams:
    """The grams of ``level`` tokens that end at each token, or also at the begin mark before the first."""
    tokens, text, place = _sequence(w, order)
    key = ctx = low = _codes(tokens, codes)
    for _ in range(level - 1):
        ctx, low = np.concatenate([key[:1], key[:-1]]), key
        key = _pair(ctx, low)
    keep = place >= order - 1 - int(contexts)
    return _Grams(text[keep], ctx[keep], low[keep], key[keep])


def _rows(docs: DataFrame, train: Column | None) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seen = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    doc = F.col("doc_id").cast("long")
    return docs.select(doc.alias("doc_id"), text.alias("text"), seen.alias("train"), F.xxhash64(doc, text).alias("row"))


def _counted(rows: DataFrame, order: int, codes: np.ndarray, level: int, names: list[str]) -> DataFrame:
    """``names`` (of key, ctx, low) with ``c, n``, occurrences in training and in all rows.

    Occurrences are summed in each task before they are shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(codes)
        for batch in batches:
            seen = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for begin, end, w in W.slices(batch, lower=True, size=_SLICE):
                g = _level(w, order, places, level)
                key, at, back = np.unique(g.key, return_index=True, return_inverse=True)
                n = np.bincount(back, minlength=len(key))
                c = np.bincount(back[seen[begin:end][g.text]], minlength=len(key))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.astype(np.int64)) for x in (*[getattr(g, x)[at] for x in names], c, n)], [*names, "c", "n"])

    return rows.select("text", "train").mapInArrow(run, ", ".join(f"{x} long" for x in [*names, "c", "n"]))


def _partitions(spark, tokens: int) -> int:
    """So many that a task meets about ``TASK_ROWS`` grams at most: its share of all tokens."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // TASK_ROWS))


def _summed(made: DataFrame, names: list[str], partitions: int) -> DataFrame:
    """``names`` with the sums of ``c``: grams are dealt out by name and added up on arrays."""
    def whole(parts: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(parts, axis=1)
        _, at, back = np.unique(_pair(rows[-3], rows[-2]), return_index=True, return_inverse=True)
        out = rows[:, at]
        out[-1] = np.bincount(back, weights=rows[-1], minlength=len(at)).astype(np.int64)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [np.zeros((len(names) + 1, 0), dtype=np.int64)], 0
        for batch in batches:
            parts.append(np.stack([batch.column(x).to_numpy() for x in [*names, "c"]]))
            waiting += batch.num_rows
            if waiting > TASK_ROWS // 2:
                parts, waiting = [whole(parts)], 0
        for begin in range(0, (out := whole(parts)).shape[1], 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out[:, begin:begin + (1 << 16)]], [*names, "c"])

    dealt = made.select(*names, "c").repartition(partitions, "ctx", "low")
    return dealt.mapInArrow(run, ", ".join(f"{x} long" for x in [*names, "c"]))


def _answered(asked: DataFrame, table: DataFrame, partitions: int) -> DataFrame:
    """``row, value``: sums of the numbers of the grams each row asks for, part by part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.zeros((2, 0), dtype=np.int64)]
        numbers, known = [np.zeros(0)], [np.zeros(0, dtype=np.int64)]
        for batch in batches:
            ctx, low = (batch.column(x).to_numpy() for x in ("ctx", "low"))
            given = batch.column("value").is_valid().to_numpy(zero_copy_only=False)
            key = _pair(ctx, low)
            known.append(key[given])
            numbers.append(batch.column("value").filter(pa.array(given)).to_numpy())
            parts.append(np.stack([key[~given], batch.column("row").filter(pa.array(~given)).to_numpy()]))
        keys, values, (key, row) = np.concatenate(known), np.concatenate(numbers), np.concatenate(parts, axis=1)
        order = np.argsort(keys)
        at, found = Places(keys[order]).find(key)
        rows, back = np.unique(row[found], return_inverse=True)
        sums = np.bincount(back, weights=values[order][at[found]], minlength=len(rows))
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(sums)], ["row", "value"])

    both = asked.select("row", "ctx", "low", F.lit(None).cast("double").alias("value")).unionByName(
        table.select(F.lit(None).cast("long").alias("row"), "ctx", "low", "value"))
    return both.repartition(partitions, "ctx", "low").mapInArrow(run, "row long, value double")


def _looked_up(rows: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``table`` at ``key``: frequent words by broadcast, the rest by shuffle."""
    head = F.broadcast(table.filter("key >= 0"))  # one row per code, at most HEAD + 1
    join = lambda some, t: some.join(t.withColumnRenamed("key", column), column)
    return join(rows.filter(F.col(column) >= 0), head).unionByName(
        join(rows.filter(F.col(column) < 0), table.filter("key < 0")))


def _counts_of_counts(table: DataFrame) -> dict[int, int]:
    found = table.filter(F.col("c").between(1, K + 1)).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r.c: r.n for r in found}


def _head(rows: DataFrame, *values: str) -> Head:
    """Keys ``key`` (or pairs ``ctx, low``) and numbers of rows known to be few."""
    found = rows.toPandas()
    key = found["key"].to_numpy(np.int64) if "key" in found else _pair(
        found["ctx"].to_numpy(np.int64), found["low"].to_numpy(np.int64))
    order = np.argsort(key)
    return Head(key[order], found[list(values)].to_numpy(np.float64)[order])


def fit(docs: DataFrame, train: Column | None = None, order: int = ORDER) -> Model:
    """The model of the rows where ``train`` holds; frequencies of all rows say what is frequent."""
    rows, none = _rows(docs, train), np.zeros(0, dtype=np.uint64)
    words = _counted(rows, order, none, 1, ["key"]).groupBy("key").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    words = stage(words, "katz-words")
    total = words.agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    tokens, types, least = total.c or 0, total.v, (total.n or 0) / HEAD
    frequent = words.filter(F.col("n") >= least).select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64)
    # Keys have their top bit set already; the begin mark is always in every task.
    codes = np.unique(np.append(frequent, _BEGIN | _TOP))
    shown = words.select("key", "c", "n")
    # As many rows as there are codes.
    coded = docs.sparkSession.createDataFrame(pa.table({"hash": codes.view(np.int64), "code": np.arange(len(codes))}))
    shown = shown.join(F.broadcast(coded), F.col("key") == F.col("hash"), "left").select(
        F.coalesce("code", "key").alias("key"), "c", "n")

    d = discounts(_counts_of_counts(words))
    lost = words.filter("c > 0").agg(F.sum(F.col("c") - _discounted(F.col("c"), d))).first()[0] or 0.0
    whole = tokens if lost > 1e-9 else tokens + 1
    unknown = math.log10((lost if lost > 1e-9 else 1) / whole)
    smooth = tokens + 0.5 * (types + 1)
    lowest = math.log10(0.5 / smooth)
    seen = F.col("c") > 0
    level = stage(shown.select(
        "key", "c", F.when(seen, F.log10(_discounted(F.col("c"), d) / whole)).otherwise(unknown).alias("logp"),
        (F.log10((F.col("c") + 0.5) / smooth) - lowest).alias("base"), seen.cast("double").alias("known")), "katz-unigrams")
    drop_stage(words)

    numbered, grams, heads, staged = [], [], [], [level]
    gain = level.select("key", "c", (F.col("logp") - unknown).alias("value"), "base", "known")
    for m in range(2, order + 1):
        last = m == order
        names = ["ctx", "low"] if last else ["key", "ctx", "low"]
        table = _summed(_counted(rows.filter("train"), order, codes, m, names), names, _partitions(docs.sparkSession, tokens))
        table = table.withColumn(
            "part", F.col("ctx").bitwiseXOR(F.col("low")).bitwiseAND(F.lit(PARTS - 1)).cast("int"))
        table = stage(table.sortWithinPartitions("part", "ctx", "low"), f"katz-grams-{m}", partition_by=["part"])
        d = discounts(_counts_of_counts(table))
        low = level.select("key", F.col("logp").alias("low_logp"))
        contexts = _looked_up(table.select("ctx", "low", "c"), "low", low).groupBy("ctx").agg(
            F.sum("c").alias("t"), F.sum(F.col("c") - _discounted(F.col("c"), d)).alias("lost"),
            F.sum(F.pow(F.lit(10.0), "low_logp")).alias("covered"))
        freed = F.col("lost") > 1e-9
        whole = F.when(freed, F.col("t")).otherwise(F.col("t") + 1)
        rest = F.greatest(1 - F.col("covered"), F.lit(1e-15))
        contexts = stage(contexts.select(
            F.col("ctx").alias("key"), F.log10(whole).alias("whole"),
            F.log10(F.when(freed, F.col("lost")).otherwise(1.0) / whole / rest).alias("backoff")), f"katz-contexts-{m}")

        def numbers(some: DataFrame, d: list[float] = d, low: DataFrame = low, contexts: DataFrame = contexts) -> DataFrame:
            known = _looked_up(_looked_up(some, "low", low), "ctx", contexts)
            logp = F.log10(_discounted(F.col("c"), d)) - F.col("whole")
            return known.withColumn("logp", logp).withColumn("value", logp - F.col("backoff") - F.col("low_logp"))

        # The shorter grams' numbers are complete now: gain plus weight as a context.
        full = gain.join(contexts.select("key", "backoff"), "key", "full")
        fill = [F.coalesce(c, F.lit(0.0)).alias(c) for c in gain.columns if c in ("base", "known")]
        full = stage(full.select("key", (F.coalesce("value", F.lit(0.0)) + F.coalesce("backoff", F.lit(0.0))).alias("value"),
                                 F.coalesce("c", F.lit(0)).alias("c"), *fill), f"katz-numbers-{m - 1}")
        columns = ["value"] + [c for c in ("base", "known") if c in full.columns]
        often = full.filter("key >= 0") if m == 2 else full.filter(F.col("c") > least)
        heads.append(_head(often.select("key", *columns), *columns))
        numbered.append(full)
        staged += [table, contexts]
        if last:
            heads.append(_head(numbers(table.filter(F.col("c") > least)).select("ctx", "low", "value"), "value"))
            grams.append(lambda part, table=table, numbers=numbers, least=least: numbers(
                table.filter((F.col("part") == part) & (F.col("c") <= least)).select("ctx", "low", "c")).select("ctx", "low", "value"))
        else:
            level = stage(numbers(table).select("key", "c", "logp", "value"), f"katz-level-{m}")
            staged.append(level)
            gain = level.select("key", "c", "value")
    if order == 1:
        numbered.append(gain)
        heads.append(_head(gain.filter("key >= 0"), "value", "base", "known"))
    return Model(order, tokens, types, unknown, numbered[0], [*numbered[1:], *grams], codes, heads, staged)


def _frequent_sums(rows: DataFrame, model: Model) -> DataFrame:
    """``doc_id, row, train, n_tokens, score, base, known``: what the heads give to each row."""
    spark = rows.sparkSession
    heads = spark.sparkContext.broadcast([(h.keys, h.values) for h in model.heads])
    order, codes = model.order, model.codes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, places = [_KnownHead(*h) for h in heads.value], Places(codes)
        for batch in batches:
            for begin, end, w in W.slices(batch, lower=True, size=_SLICE):
                some, size = batch.slice(begin, end - begin), end - begin
                total = np.zeros((size, 3))
                for level, head in enumerate(known, 1):
                    g = _level(w, order, places, level, contexts=level < order)
                    part = head.sums(g.text, g.key, size)
                    total[:, :part.shape[1]] += part
                yield pa.RecordBatch.from_arrays(
                    [*[some.column(c) for c in ("doc_id", "row", "train")], pa.array(np.diff(w.first) + 1),
                     *[pa.array(np.ascontiguousarray(v)) for v in total.T]],
                    ["doc_id", "row", "train", "n_tokens", "score", "base", "known"])

    return rows.mapInArrow(
        run, "doc_id long, row long, train boolean, n_tokens long, score double, base double, known double")


def _requests(rows: DataFrame, model: Model, level: int, part: int | None) -> DataFrame:
    """``row`` and ``key``, or ``ctx, low`` of the longest: the grams of each row that are not in the head."""
    names = ["ctx", "low"] if level == model.order > 1 else ["key"]
    spark = rows.sparkSession
    head = model.heads[level - 1]
    keys = spark.sparkContext.broadcast(head.keys)
    order, codes = model.order, model.codes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, places = Places(keys.value), Places(codes)
        for batch in batches:
            row = batch.column("row").to_numpy()
            for begin, _, w in W.slices(batch, lower=True, size=_SLICE):
                g = _level(w, order, places, level, contexts=level < order)
                if part is not None:
                    g = _Grams(*[x[_part(g.ctx, g.low) == part] for x in g])
                keep = ~known.find(g.key)[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[keep]) for x in (row[begin:][g.text], *[getattr(g, x) for x in names])], ["row", *names])

    return rows.select("row", "text").mapInArrow(run, ", ".join(f"{x} long" for x in ["row", *names]))


def score(docs: DataFrame, model: Model, train: Column | None = None) -> DataFrame:
    """``doc_id, train, n_tokens, n_known, base_score, score`` of every whole text, logarithms to base 10."""
    rows = _rows(docs, train)
    own = stage(_frequent_sums(rows, model), "katz-frequent")
    found = _requests(rows, model, 1, None).join(
        model.unigrams.filter("key < 0").select("key", "value", "base", "known"), "key")
    own_tokens = own.agg(F.sum("n_tokens")).first()[0] or 0
    sums = [stage(found.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("value", "base", "known")]), "katz-sums")]
    nothing = [F.lit(0.0).alias("base"), F.lit(0.0).alias("known")]
    for level, table in enumerate(model.grams, 2):
        for part in range(PARTS if level == model.order else 1):
            if level < model.order:
                found = _requests(rows, model, level, None).join(table.select("key", "value"), "key")
            else:
                found = _answered(_requests(rows, model, level, part), table(part),
                                  _partitions(docs.sparkSession, own_tokens))
            sums.append(stage(found.groupBy("row").agg(F.sum("value").alias("value")).select("row", "value", *nothing), "katz-sums"))
    every = reduce(DataFrame.unionByName, sums).groupBy("row").agg(*[F.sum(c).alias(f"more_{c}") for c in ("value", "base", "known")])
    # Equal rows of one id asked together: what they got is shared.
    times = own.groupBy("row").agg(F.count(F.lit(1)).alias("times"))
    out = own.join(times, "row").join(every, "row", "left")
    share = lambda c: F.coalesce(F.col(f"more_{c}"), F.lit(0.0)) / F.col("times")
    lowest = math.log10(0.5 / (model.tokens + 0.5 * (model.types + 1)))
    return out.select(
        "doc_id", "train", "n_tokens", F.round(F.col("known") + share("known")).cast("long").alias("n_known"),
        (F.col("n_tokens") * lowest + F.col("base") + share("base")).alias("base_score"),
        (F.col("n_tokens") * model.unknown + F.col("score") + share("value")).alias("score"))


def learn_and_score(docs: DataFrame, train: Column, order: int = ORDER) -> DataFrame:
    """All rows scored by the model of those where ``train`` holds; ``train_tokens`` in each."""
    model = fit(docs, train, order)
    scored = score(docs, model, train)
    drop_stage(*model.staged)  # the sums are written
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long"))
