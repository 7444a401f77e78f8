"""Similarity join of documents on word n-grams by token-combination prefixes.

Tokens are the distinct n-grams of a text, ordered by how many documents have them
(in classes, the rare ones first) and then by their hash. Two sets as alike as asked
share a token among the first ``size - least overlap + 1`` of each (the prefix), and
sizes within the threshold put them into a common size class. The classes come from
counters of fixed number, which tokens share by hash: an error in them moves a token in
the order all sets have in common, and loses no link.

1. Equal sets form one class; only its least id goes on.
2. Prefix tokens are counted per size class. A rare one (up to ``RARE`` documents)
   is an index key of its own: the documents under it are candidates.
3. A document with a frequent token extends its prefix to the whole set and is
   indexed by combinations: the hash range is cut into one more part than the sets
   may differ in (plus slack for empty parts), so a pair has a part with exactly
   the same tokens, and the tokens of a part together are one key.
4. Of its combinations that more than ``RARE`` documents have, a document leaves out as
   many of the commonest as the spare parts allow. A list still longer marks a group
   of near copies: all are compared with ``LEADERS`` documents of the list, chosen by
   hash. Only those outside its largest component then look for partners in it.
5. Candidates are cut by upper bounds, from the prefix tokens they share and from parity
   sketches of fixed size; the rest is verified on whole texts, first one link per
   document, then what still parts components.

Defined results: a text with fewer words than the n-gram is one token; null and empty
texts have no tokens and no links; rows of the same id are one vertex with several
texts; rows with a null id have no component (null); an empty table gives no rows.
Only the id and text columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import drop_stage, stage
from . import words as W
from .components import components

RARE = 32
SKETCH_BITS = 1024
#: Documents of a crowded list with which all others of it are compared.
LEADERS = 4
#: Counters for the frequencies of tokens; a task holds four bytes of each, and one byte of each is broadcast.
COUNTERS = 1 << 24
#: Bits in a bitmap of ids for each id it is asked about, and the power of two it has at most (8 MB).
MARKS, MOST_MARKS = 16, 26
_SLACK, _SPARE_SHARE = 3, 0.1
_CHUNKS, _OCTAVE, _CLASS_BITS = 64, 8, 4


class Likeness(NamedTuple):
    """n-grams of ``width`` words; alike at ``100 * common >= percent * union``."""

    width: int = 5
    percent: int = 80

    def least(self, n):
        """The least overlap of a set of ``n`` tokens with a set it is alike to."""
        return -(-self.percent * n // 100)

    def size_class(self, n: np.ndarray, widen: bool = False) -> np.ndarray:
        """Sizes alike lie in one class, or the larger in the widened class of the smaller."""
        size = np.maximum(n, 1) * (100 / self.percent * (1 + 1e-9) if widen else 1.0)
        return np.floor(np.log(size) / self._step() + 1e-12).astype(np.int64)

    def _step(self) -> float:
        return math.log(100 / min(self.percent, 70))

    def parts(self, size_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of hash ranges in a size class and how many of them may be empty."""
        most = np.exp((size_class + 1) * self._step())
        differ = np.floor(2 * most * (100 - self.percent) / (100 + self.percent) + 1e-6)
        slack = np.ceil(differ * _SPARE_SHARE) + _SLACK
        return (differ + 1 + np.where(differ < 1, 0, slack)).astype(np.int64), np.where(differ < 1, 0, slack).astype(np.int64)


def _sets(w: W.Words, width: int, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams: ``(text, token)`` sorted by both, and set sizes.

    With ``classes`` the first bits of a token are its frequency class.
    """
    n_texts, counts = len(w.first) - 1, np.diff(w.first)
    token, inside = W.windows(w, width)
    text, token = W.texts_of(w)[inside], token[inside]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        text, token = np.concatenate([text, short]), np.concatenate([token, W.wholes(w)[short]])
    if classes is not None:
        front = classes[_counter(token, len(classes))].astype(np.uint64)
        token = front << np.uint64(64 - _CLASS_BITS) | token >> np.uint64(_CLASS_BITS)
    order = np.lexsort((token, text))
    text, token = text[order], token[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (token[1:] != token[:-1])
    text, token = text[new], token[new]
    return text, token, np.bincount(text, minlength=n_texts)


def _lists(lengths: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)),
                                    pa.array(values.view(np.int64)))


def _counter(token: np.ndarray, counters: int) -> np.ndarray:
    return (token & np.uint64(counters - 1)).astype(np.int64)


def frequency_classes(docs: DataFrame, like: Likeness) -> np.ndarray:
    """The frequency class of each counter: 0 where its tokens may all be rare.

    Every task counts all its documents; counters are added chunk by chunk, and one byte
    each (a logarithm) comes to the driver, where what is above the mean gives the class.
    """
    counters = COUNTERS
    chunk_size = counters // _CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, dtype=np.uint32)
        for batch in batches:
            for _, _, found in W.slices(batch, lower=True):
                np.add.at(counts, _counter(_sets(found, like.width)[1], counters), 1)
        for chunk, part in enumerate(counts.reshape(_CHUNKS, chunk_size)):
            if part.any():  # few counts need more than their lowest byte
                packed, high = zlib.compress(part.astype(np.uint8).tobytes(), 1), np.flatnonzero(part >> 8)
                more = np.stack([high.astype(np.uint32), part[high] >> 8]).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk]), pa.array([packed]), pa.array([more])], ["chunk", "counts", "more"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed, more in zip(*[batch.column(c).to_pylist() for c in ("chunk", "counts", "more")]):
                if chunk not in totals:
                    totals[chunk] = np.zeros(chunk_size, dtype=np.int64)
                totals[chunk] += np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
                high, value = np.frombuffer(more, dtype=np.uint32).reshape(2, -1)
                totals[chunk][high] += value.astype(np.int64) << 8
        for chunk, total in totals.items():
            logs = np.minimum(np.floor(_OCTAVE * np.log2(total + 1.0) + 1e-9), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([logs.tobytes()])], ["chunk", "logs"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        count, "chunk long, counts binary, more binary")
    summed = stage(parts.repartition("chunk").mapInArrow(add_up, "chunk long, logs binary"), "jaccard-frequencies")
    logs = np.zeros((_CHUNKS, chunk_size), dtype=np.uint8)
    for row in summed.toLocalIterator():  # at most _CHUNKS rows
        logs[row.chunk] = np.frombuffer(row.logs, dtype=np.uint8)
    drop_stage(summed)
    value = 2.0 ** (np.arange(256) / _OCTAVE) - 1
    # Chunk by chunk: as indices the bytes take eight times their room.
    mean = float(sum(np.bincount(chunk, minlength=256) for chunk in logs) @ value) / counters
    clear = max(RARE / 4, 4 * math.sqrt(mean))
    found = np.where(value - mean > clear, 1 + np.log2(np.maximum(value - mean, clear) / clear), 0)
    found = np.minimum(found, (1 << _CLASS_BITS) - 1).astype(np.uint8)
    for chunk in logs:
        chunk[:] = found[chunk]
    return logs.ravel()


def signatures(docs: DataFrame, like: Likeness, classes: Broadcast) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, prefix, sketch``: set size, 128-bit set digest, prefix
    tokens, and for each of ``SKETCH_BITS`` hash values whether an odd number of tokens has it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, found in W.slices(batch, lower=True):
                text, token, size = _sets(found, like.width, classes.value)
                first = np.concatenate([[0], np.cumsum(size)])
                digests = []
                for salt in (0x1234567, 0x89ABCDE):
                    run_ = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(token + np.uint64(salt)), dtype=np.uint64)])
                    digests.append(pa.array((run_[first[1:]] - run_[first[:-1]]).view(np.int64)))
                length = np.where(size > 0, size - like.least(size) + 1, 0)
                odd = np.bincount(text * SKETCH_BITS + (token >> np.uint64(20) & np.uint64(SKETCH_BITS - 1)).astype(np.int64),
                                  minlength=(end - begin) * SKETCH_BITS) & 1
                sketch = np.packbits(odd.astype(bool)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, end - begin), pa.array(size.astype(np.int64)), *digests,
                     _lists(length, token[W.ragged(first[:-1], length)]),
                     _lists(np.full(end - begin, SKETCH_BITS // 64), sketch)],
                    ["doc_id", "n_shingles", "d1", "d2", "prefix", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, prefix array<long>, sketch array<long>")


def _spread_sketch(name: str) -> list[Column]:
    """The numbers of a sketch as columns ``name0, name1, ...``: compared without lambdas they stay in generated code."""
    return [F.col("sketch")[i].alias(f"{name}{i}") for i in range(SKETCH_BITS // 64)]


def _differ(x: str, y: str) -> Column:
    """In how many bits two spread sketches differ."""
    bits = [F.bit_count(F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}"))) for i in range(SKETCH_BITS // 64)]
    return reduce(add, bits).cast("long")


class _Marks(NamedTuple):
    """A staged bitmap of ids by hash, one row a bucket: at most 2 to the ``MOST_MARKS`` bits.

    It has about ``MARKS`` bits for each of the ``among`` rows that it will be asked about, so
    those marked by chance are few against the marked ids, not only against all rows.
    """

    buckets: DataFrame
    bits: int

    @classmethod
    def of(cls, ids: DataFrame, column: str, among: int | None = None) -> "_Marks":
        bits = 1 << min(max((MARKS * (among or ids.count())).bit_length(), 15), MOST_MARKS)
        spots = ids.select(cls._spot(column, bits).alias("spot"))
        return cls(stage(spots.groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("marks")), "jaccard-marks"), bits)

    @staticmethod
    def _spot(column: str, bits: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(bits)) + 1

    def on(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        """``rows`` with the boolean ``name``: true for every id that is marked, and for few others.

        The bitmap travels to every task, so the rows need not be shuffled.
        """
        spot = self._spot(f"row.{column}", self.bits)
        # The row travels as one struct: no name of its columns can clash with ours.
        asked = rows.select(F.struct(*rows.columns).alias("row")).select(
            "row", F.bitmap_bit_position(spot).cast("int").alias("at"), F.bitmap_bucket_number(spot).alias("to"))
        byte = F.conv(F.hex(F.expr("substring(marks, at div 8 + 1, 1)")), 16, 10).cast("int")
        marked = F.coalesce(F.expr("1 << (at % 8)").bitwiseAND(byte) != 0, F.lit(False))
        # One row a bucket: no row meets two.
        return asked.join(F.broadcast(self.buckets), F.col("to") == F.col("bucket"), "left").select("row.*", marked.alias(name))


def _near_enough(pairs: DataFrame, reps: DataFrame, like: Likeness) -> DataFrame:
    """Pairs whose parity sketches leave the threshold within reach.

    Every token that only one of two sets has changes one bit, so the sketches differ
    in no more bits than the sets in tokens.
    """
    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), *_spread_sketch(f"s{c}"))
    differ = _differ("sa", "sb")
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    # Sizes first: the sketches are compared only where those fit.
    fits = F.abs(F.col("na") - F.col("nb")) * (100 + like.percent) <= (F.col("na") + F.col("nb")) * (100 - like.percent)
    near = differ * (100 + like.percent) <= (F.col("na") + F.col("nb")) * (100 - like.percent)
    return joined.filter(fits & near).select("a", "b").distinct()


def _keys(reps: DataFrame, like: Likeness) -> DataFrame:
    """``key, doc``: each prefix token in each size class of its document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix")
            token = prefix.values.to_numpy(zero_copy_only=False).view(np.uint64)
            length = np.diff(prefix.offsets.to_numpy())
            doc = np.repeat(batch.column("doc_id").to_numpy(), length)
            n = batch.column("n_shingles").to_numpy()
            own, wide = like.size_class(n), like.size_class(n, widen=True)
            for size_class, here in ((own, np.ones(len(n), dtype=bool)), (wide, wide != own)):
                keep = np.repeat(here, length)
                salt = W.mix(np.repeat(size_class, length)[keep].astype(np.uint64) + np.uint64(17))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(W.mix(token[keep] ^ salt).view(np.int64)), pa.array(doc[keep])], ["key", "doc"])

    return reps.select("doc_id", "n_shingles", "prefix").mapInArrow(run, "key long, doc long")


def _combinations(texts: DataFrame, like: Likeness) -> DataFrame:
    """``key, doc, wide, spare``: the tokens of each hash range together, per size class.

    There are more ranges than the sets may differ in, by the slack. A pair has at
    least ``slack + 1`` equal ranges; those that are empty are left out, so ``spare``,
    the slack less the empty ranges, more keys than one are shared by a pair.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, found in W.slices(batch, lower=True):
                text, token, n = _sets(found, like.width)
                doc = batch.column("doc_id").slice(begin, end - begin).to_numpy()
                own, wide = like.size_class(n), like.size_class(n, widen=True)
                for is_wide, size_class, here in ((False, own, n > 0), (True, wide, (wide != own) & (n > 0))):
                    parts, slack = like.parts(size_class)
                    keep = here[text]
                    t, h = text[keep], token[keep]
                    part = ((h >> np.uint64(32)) * parts[t].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
                    base = np.concatenate([[0], np.cumsum(np.where(here, parts, 0))])
                    cell = base[t] + part
                    total = np.zeros(int(base[-1]), dtype=np.uint64)
                    np.add.at(total, cell, W.mix(h + np.uint64(77)))
                    filled = np.bincount(cell, minlength=int(base[-1])) > 0
                    owner = np.repeat(np.arange(len(n)), np.where(here, parts, 0))
                    place = np.arange(int(base[-1])) - base[owner]
                    empty = np.bincount(owner[~filled], minlength=len(n))
                    use = filled | (empty > slack)[owner]
                    salt = W.mix((size_class[owner] * 1_000_003 + place).astype(np.uint64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(W.mix(total ^ salt)[use].view(np.int64)), pa.array(doc[owner[use]]),
                         pa.array(np.full(int(use.sum()), is_wide)),
                         pa.array(np.maximum(slack - empty, 0)[owner[use]].astype(np.int32))],
                        ["key", "doc", "wide", "spare"])

    return texts.select("doc_id", "text").mapInArrow(run, "key long, doc long, wide boolean, spare int")


def _rarest(rows: DataFrame) -> DataFrame:
    """Of the crowded keys of each document all but the ``spare`` commonest.

    Two alike documents without an uncrowded key in common share more than ``spare``
    crowded ones, so they share one of those that are left. A document has no more
    keys than tokens, which bounds the window.
    """
    own = Window.partitionBy("doc", "wide")
    ranked = rows.select(
        "*", F.row_number().over(own.orderBy(F.desc("n"), F.desc("key"))).alias("rank"))
    return ranked.filter("rank > spare").select("key", "doc").distinct()


def _shared(index: DataFrame, name: str) -> DataFrame:
    """The rows of ``index`` whose key others have too, with ``n``, how many rows do.

    The index itself is computed twice and never written: most of its keys are alone.
    """
    counts = stage(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), f"{name}-counts")
    out = stage(index.join(counts, "key"), name)
    drop_stage(counts)
    return out


def _pairs_of_short_lists(shared: DataFrame) -> DataFrame:
    """``a, b, c``: pairs ``a < b`` under keys of at most ``RARE`` rows, and under how many."""
    lists = shared.filter(F.col("n").between(2, RARE)).groupBy("key").agg(
        F.array_sort(F.collect_set("doc")).alias("docs"))
    pairs = F.flatten(F.transform("docs", lambda a, i: F.transform(
        F.slice("docs", i + 2, F.lit(RARE)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = lists.filter(F.size("docs") > 1).select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))


def _candidates(pairs: DataFrame, reps: DataFrame, like: Likeness) -> DataFrame:
    """Pairs that neither the sketches nor the whole prefixes rule out.

    Up to the lesser of the two last prefix tokens both sets are fully known; beyond
    it at most the smaller rest can be common.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            (va, oa), (vb, ob) = ((c.values.to_numpy(zero_copy_only=False).view(np.uint64), c.offsets.to_numpy())
                                  for c in (batch.column("pa"), batch.column("pb")))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = va[oa[i]:oa[i + 1]], vb[ob[i]:ob[i + 1]]
                last = min(x[-1], y[-1])
                known_x, known_y = np.searchsorted(x, last, "right"), np.searchsorted(y, last, "right")
                common = len(np.intersect1d(x[:known_x], y[:known_y], assume_unique=True))
                common += min(na[i] - known_x, nb[i] - known_y)
                keep[i] = 100 * common >= like.percent * (na[i] + nb[i] - common)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("prefix").alias(f"p{c}"))
    joined = _near_enough(pairs, reps, like).join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long").distinct()


def _within_reach(pairs: DataFrame, facts: DataFrame, like: Likeness) -> DataFrame:
    """Pairs whose shared prefix tokens leave the threshold within reach.

    The set whose prefix ends first has only its rest beyond it, so a pair has at
    most the rare tokens it was found by, its frequent ones, and the larger rest in
    common.
    """
    side = lambda c: facts.select(F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("size", "rest", "crowd")])
    common = F.col("c") + F.least("crowd_a", "crowd_b") + F.greatest("rest_a", "rest_b")
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.filter(common * (100 + like.percent) >= like.percent * (F.col("size_a") + F.col("size_b"))).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """``a, b, common, total``: exact overlap and union of each pair's sets."""
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                some = batch.slice(begin, 64)
                both = pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([some.column("ta"), some.column("tb")])], ["text"])
                data, offsets = W.column(both, "text")
                text, token, size = _sets(W.find(data, offsets, lower=True), like.width)
                n = some.num_rows
                order = np.lexsort((token, text % n))
                pair, token = (text % n)[order], token[order]
                twice = (pair[1:] == pair[:-1]) & (token[1:] == token[:-1])
                common = np.bincount(pair[1:][twice], minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [some.column("a"), some.column("b"), pa.array(common.astype(np.int64)),
                     pa.array((size[:n] + size[n:] - common).astype(np.int64))], ["a", "b", "common", "total"])

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
    out = joined.mapInArrow(run, "a long, b long, common long, total long")
    # An id with several texts: the likest two count.
    return out.groupBy("a", "b").agg(F.max(F.struct(F.col("common") / F.col("total"), "common", "total")).alias("m")).select(
        "a", "b", "m.common", "m.total")


def _alike(checked: DataFrame, like: Likeness) -> DataFrame:
    return checked.filter(F.lit(100) * F.col("common") >= F.lit(like.percent) * F.col("total")).select("a", "b")


def _same(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends are not yet in one component."""
    ca = comps.select(F.col("node").alias("xa"), F.col("component").alias("ca"))
    cb = comps.select(F.col("node").alias("xb"), F.col("component").alias("cb"))
    joined = pairs.join(ca, F.col("a") == F.col("xa"), "left").join(cb, F.col("b") == F.col("xb"), "left")
    return joined.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def _left_open(hot: DataFrame, comps: DataFrame, reps: DataFrame, like: Likeness) -> DataFrame:
    """Pairs under one key that are in different components though their sketches allow a link.

    Documents of a list's largest component need no partner inside it, so only the
    others look for partners; sketches are compared in the join and no other pair
    becomes a row.
    """
    comp = comps.select(F.col("node").alias("v"), "component")
    # Each document meets its component once, with all its keys in one row: no more than it has tokens.
    owned = hot.groupBy("doc").agg(F.collect_list("key").alias("keys"))
    rows = owned.join(comp, F.col("doc") == F.col("v"), "left").select(
        F.explode("keys").alias("key"), "doc", F.coalesce("component", "doc").alias("c"))
    # One row a list says both whether it lies in several components and which is its largest.
    apart = rows.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("key").alias("k")).agg(
        F.max_by("c", "n").alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").drop("parts")
    rows = stage(rows.join(apart, F.col("key") == F.col("k")).drop("k"), "jaccard-apart")
    facts = reps.select(F.col("doc_id").alias("d"), F.col("n_shingles").alias("size"), "sketch")
    rows = rows.join(facts, F.col("doc") == F.col("d"))
    side = lambda f, c: f.select(F.col("key").alias(f"k{c}"), F.col("doc").alias(c), F.col("c").alias(f"c{c}"),
                                 F.col("size").alias(f"n{c}"), *_spread_sketch(f"s{c}"))
    x, y = side(rows.filter("c <> main"), "x"), side(rows, "y")
    differ = _differ("sx", "sy")
    most = (F.col("nx") + F.col("ny")) * (100 - like.percent)
    near = (F.abs(F.col("nx") - F.col("ny")) * (100 + like.percent) <= most) & (differ * (100 + like.percent) <= most)
    pairs = x.join(y, (F.col("kx") == F.col("ky")) & (F.col("cx") != F.col("cy")) & near)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def classes(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row: the least id reachable by links."""
    frequency = docs.sparkSession.sparkContext.broadcast(frequency_classes(docs, like))
    rows = stage(signatures(docs, like, frequency), "jaccard-signatures")
    frequency.destroy()  # the driver's copies too
    filled = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = stage(filled.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    key = ["n_shingles", "d1", "d2"]
    reps = filled.join(same, key).filter("doc_id = rep").select("doc_id", "n_shingles", "prefix", "sketch", "d1", "d2")
    reps = stage(reps.dropDuplicates(["doc_id", *key]).drop("d1", "d2"), "jaccard-representatives")
    copies = stage(filled.join(same, key).filter("doc_id <> rep").select(
        F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), "jaccard-copies")
    whole, rows = rows, stage(rows.select("doc_id", "n_shingles"), "jaccard-sizes")
    drop_stage(whole, same)

    shared = _shared(_keys(reps, like), "jaccard-index")
    crowded = shared.filter(F.col("n") > RARE).groupBy("doc").agg(F.count(F.lit(1)).alias("crowd"))
    facts = reps.groupBy(F.col("doc_id").alias("id")).agg(
        F.min("n_shingles").alias("size"), F.max(F.col("n_shingles") - F.size("prefix")).alias("rest"))
    facts = facts.join(crowded, F.col("id") == F.col("doc"), "left").select(
        "id", "size", "rest", F.coalesce("crowd", F.lit(0)).alias("crowd"))
    facts = stage(facts, "jaccard-facts")
    pairs = stage(_within_reach(_pairs_of_short_lists(shared), facts, like), "jaccard-pairs")
    wanted = stage(facts.filter("crowd > 0").select(F.col("id").alias("doc"), F.lit(True).alias("crowded")).unionByName(
        pairs.select(F.explode(F.array("a", "b")).alias("doc"), F.lit(False).alias("crowded")))
        .groupBy("doc").agg(F.max("crowded").alias("crowded")), "jaccard-wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # A few documents more than wanted change no link: what they meet is verified too.
    among = rows.count()
    asked, crowd = _Marks.of(wanted, "doc", among), _Marks.of(wanted.filter("crowded"), "doc", among)
    texts = asked.on(texts.filter("doc_id IS NOT NULL"), "doc_id", "asked").filter("asked")
    texts = stage(crowd.on(texts.drop("asked"), "doc_id", "crowded"), "jaccard-texts")
    every, reps = reps, asked.on(reps, "doc_id", "asked").filter("asked").drop("asked")
    drop_stage(shared, facts, wanted, crowd.buckets)

    combos = _shared(_combinations(texts.filter("crowded"), like), "jaccard-combinations")
    hot = stage(_rarest(combos.filter(F.col("n") > RARE)), "jaccard-crowded")
    # Leaders by several hashes: a group that fills much of a list has one of them in it.
    leaders = F.array_distinct(F.array(*[F.min_by("doc", F.xxhash64(F.lit(i), "doc")) for i in range(LEADERS)]))
    hot_counts = hot.groupBy("key").agg(F.count(F.lit(1)).alias("n"), leaders.alias("leaders")).filter("n > 1")
    hot_counts = stage(hot_counts, "jaccard-crowded-counts")
    short = pairs
    pairs = pairs.unionByName(_pairs_of_short_lists(combos).select("a", "b"))
    pairs = pairs.unionByName(_pairs_of_short_lists(hot.join(hot_counts.select("key", "n"), "key")).select("a", "b"))
    pairs = stage(_candidates(pairs.distinct(), reps, like), "jaccard-candidates")
    drop_stage(short, combos)
    large = hot_counts.filter(F.col("n") > RARE).select(F.col("key").alias("k"), "leaders")
    most = hot
    hot = stage(hot.join(large, F.col("key") == F.col("k")).select("key", "doc", "leaders"), "jaccard-large")
    drop_stage(most, hot_counts)
    star = hot.select("doc", F.explode("leaders").alias("leader")).filter("doc <> leader").select(
        F.least("doc", "leader").alias("a"), F.greatest("doc", "leader").alias("b")).distinct()
    star = stage(_verified(_candidates(star, reps, like), texts, like), "jaccard-stars")

    # One link per document first; then only what still parts components.
    nearest = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    nearest = stage(_verified(nearest.join(star, ["a", "b"], "left_anti"), texts, like), "jaccard-nearest")
    links = copies.unionByName(_alike(star, like)).unionByName(_alike(nearest, like))
    comps = stage(components(links), "jaccard-components")
    seen = star.select("a", "b").unionByName(nearest.select("a", "b"))
    rest = pairs.unionByName(_candidates(_left_open(hot, comps, reps, like), reps, like)).distinct().join(seen, ["a", "b"], "left_anti")
    rest = stage(_alike(_verified(_same(rest, comps), texts, like), like), "jaccard-rest")
    # Components of components: the first ones are stars around their least id.
    first = comps.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    last = stage(components(first.unionByName(rest)), "jaccard-components")
    drop_stage(every, asked.buckets, texts, hot, star, pairs, nearest, rest, copies, comps)
    comps = last
    return rows.join(comps, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """``docs`` without documents that are like one of a smaller id, in all their columns.

    Of each component the least id stays, with all its rows. Rows with a null id and
    rows without tokens all stay.
    """
    rows = classes(docs, like).groupBy("doc_id").agg(
        F.max("n_shingles").alias("n"), F.min("component_id").alias("component"))
    gone = rows.filter("doc_id IS NOT NULL AND n > 0 AND component <> doc_id").select(F.col("doc_id").alias("gone"))
    return without(docs, gone)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows of an id in the one column of ``gone``.

    The row travels as one struct: no name of its columns can clash with ours.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = rows.join(gone.toDF("gone"), F.col("row.doc_id").cast("long") == F.col("gone"), "left_anti")
    return left.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
