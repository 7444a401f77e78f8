"""Exact nearest-neighbour joins in bounded blocks.

Queries and candidates are cut into hashed blocks; every block of queries meets
every block of candidates of its group once, inside one task, and only the k
best per query and block leave it. Neither side is ever whole in a task and no
pair is materialised as a row, so a hot group only means more blocks. Where blocks
would send the rows of both sides more often than a few times, sparse queries are
taken in rounds: disk grows with the rows, not with their square.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import lexicon
from ..session import stage
from .ranking import top_k

BLOCK_ROWS = 8192
_STEP = 512
_PAIRS = 65536
_DIGITS = 9
#: Sparse queries that meet a block of candidates at once.
_QUERIES = 64
#: Sparse candidates whose lists a task holds at once.
_CANDIDATES = 4096
#: Entries of a term in a whole block from which it is a column of a matrix, and columns at most.
_LONG, _COLUMNS = 1200, 1024
#: Pairs of entries from which a term that rows hold twice has long lists.
_REPEATED = 64
#: Columns of distances whose least bounds a query's k nearest.
_GROUP = 128


def _best(approx: np.ndarray, exact: Callable, ids: np.ndarray, k: int, slack: float):
    """Positions and distances of each query's k nearest, ties by id.

    ``approx`` may be off by ``slack``. Every candidate that could still be
    among the k is measured again with ``exact``.
    """
    cut = min(k, approx.shape[1]) - 1
    bounds = approx
    if approx.shape[1] > 2 * _GROUP * k:
        # The k-th least of the groups' least is no less than the k-th least of all.
        bounds = np.minimum.reduceat(approx, np.arange(0, approx.shape[1], _GROUP), axis=1)
    threshold = np.partition(bounds, cut, axis=1)[:, cut] + 2 * slack
    rows, cols = np.nonzero((approx <= threshold[:, None]) & np.isfinite(approx))
    distance = np.empty(len(rows))
    for at in range(0, len(rows), _PAIRS):
        part = slice(at, at + _PAIRS)
        distance[part] = np.round(exact(rows[part], cols[part]), _DIGITS)
    order = np.lexsort((ids[cols], distance, rows))
    rows, cols, distance = rows[order], cols[order], distance[order]
    starts = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - starts < k
    return rows[keep], cols[keep], distance[keep]


def _collect(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    merged = pd.concat(parts, ignore_index=True)
    merged = merged.sort_values(["query_id", "distance", "neighbour_id"], kind="stable")
    return merged.groupby("query_id", sort=False).head(k)


def _dense_block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int, exclude_self: bool):
    parts = []
    every = np.stack(candidates["vec"].to_numpy()).astype(np.float64)
    every_ids = candidates["row_id"].to_numpy()
    every_norms = np.einsum("ij,ij->i", every, every)
    for at in range(0, len(queries), _STEP):
        piece = queries.iloc[at:at + _STEP]
        q = np.stack(piece["vec"].to_numpy()).astype(np.float64)
        q_ids = piece["row_id"].to_numpy()
        q_norms = np.einsum("ij,ij->i", q, q)
        approx = q_norms[:, None] + every_norms[None, :] - 2.0 * (q @ every.T)
        if exclude_self:
            approx[q_ids[:, None] == every_ids[None, :]] = np.inf
        slack = 1e-12 * (1.0 + q_norms.max() + every_norms.max())
        rows, cols, distance = _best(
            approx, lambda r, c: ((q[r] - every[c]) ** 2).sum(axis=1), every_ids, k, slack
        )
        parts.append(pd.DataFrame({
            "query_id": q_ids[rows], "neighbour_id": every_ids[cols], "distance": distance}))
    return _collect(parts, k)


class _Postings:
    """Entries of some sparse rows in their order; ``lists`` holds them by term."""

    def __init__(self, frame: pd.DataFrame):
        lengths = frame["idx"].map(len).to_numpy().astype(np.int64)
        self.rows, filled = len(frame), lengths.sum() > 0
        self.lengths = (lengths > 0).astype(np.float64)
        self.row = np.repeat(np.arange(len(frame)), lengths)
        self.term = np.concatenate(frame["idx"].to_numpy()) if filled else np.zeros(0, dtype=np.int64)
        self.value = np.concatenate(frame["val"].to_numpy()) if filled else np.zeros(0)

    def some(self, begin: int, stop: int) -> _Postings:
        """Those of the rows from ``begin`` to before ``stop``; the entries are not copied."""
        part = object.__new__(_Postings)
        first, last = np.searchsorted(self.row, [begin, stop])
        part.lengths = self.lengths[begin:stop]
        part.rows, part.row = len(part.lengths), self.row[first:last] - begin
        part.term, part.value = self.term[first:last], self.value[first:last]
        return part

    def repeats(self) -> bool:
        """Whether a row holds a term twice, as rows of a repeated key do."""
        return bool(((self.row[1:] == self.row[:-1]) & (self.term[1:] == self.term[:-1])).any())

    @cached_property
    def lists(self) -> _Lists:
        order = np.argsort(self.term, kind="stable")
        row, value = self.row[order], self.value[order]
        terms, start, count = np.unique(self.term[order], return_index=True, return_counts=True)
        often = np.flatnonzero(count * BLOCK_ROWS > _LONG * self.rows)
        often = often[np.argsort(-count[often], kind="stable")[:_COLUMNS]]
        column = np.full(len(terms), -1)
        column[often] = np.arange(len(often))
        matrix, at = np.zeros((self.rows, len(often))), _runs(start[often], count[often])
        matrix[row[at], np.repeat(np.arange(len(often)), count[often])] = value[at]
        return _Lists(terms, start, count, row, value, column, matrix)


class _Lists(NamedTuple):
    """The entries of each term in a row; the commonest terms are columns of ``matrix`` too."""

    terms: np.ndarray
    start: np.ndarray
    count: np.ndarray
    row: np.ndarray
    value: np.ndarray
    column: np.ndarray
    matrix: np.ndarray


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _dots(q: _Postings, c: _Postings) -> np.ndarray:
    """All dot products: one matrix product for the columns, and for each query the lists
    of its other terms, added up in one pass."""
    lists = c.lists
    if not len(lists.terms):
        return np.zeros((q.rows, c.rows))
    at = np.minimum(np.searchsorted(lists.terms, q.term), len(lists.terms) - 1)
    known = lists.terms[at] == q.term
    row, value, at = q.row[known], q.value[known], at[known]
    column = lists.column[at]
    is_column = column >= 0
    own = np.zeros((q.rows, lists.matrix.shape[1]))
    own[row[is_column], column[is_column]] = value[is_column]
    out = own @ lists.matrix.T
    row, value, at = row[~is_column], value[~is_column], at[~is_column]
    starts, sizes = lists.start[at], lists.count[at]
    ends = np.searchsorted(row, np.arange(q.rows + 1))
    for query in np.flatnonzero(np.diff(ends)):
        mine = slice(ends[query], ends[query + 1])
        here = _runs(starts[mine], sizes[mine])
        weights = lists.value[here] * np.repeat(value[mine], sizes[mine])
        out[query] += np.bincount(lists.row[here], weights=weights, minlength=c.rows)
    return out


def _repeated_dots(q: _Postings, c: _Postings) -> np.ndarray:
    """Dot products where rows hold terms twice: such a term counts once if its lists are
    long on both sides, else by every pair of entries."""
    x, y = q.lists, c.lists
    _, of_q, of_c = np.intersect1d(x.terms, y.terms, assume_unique=True, return_indices=True)
    long = x.count[of_q] * y.count[of_c] > _REPEATED

    def dense(rows: int, lists: _Lists, which: np.ndarray) -> np.ndarray:
        out = np.zeros((rows, len(which)))
        at = _runs(lists.start[which], lists.count[which])
        out[lists.row[at], np.repeat(np.arange(len(which)), lists.count[which])] = lists.value[at]
        return out

    out = dense(q.rows, x, of_q[long]) @ dense(c.rows, y, of_c[long]).T
    of_q, of_c = of_q[~long], of_c[~long]
    left = _runs(x.start[of_q], x.count[of_q])
    starts, sizes = np.repeat(y.start[of_c], x.count[of_q]), np.repeat(y.count[of_c], x.count[of_q])
    right, left = _runs(starts, sizes), np.repeat(left, sizes)
    cells = x.row[left] * c.rows + y.row[right]
    return out + np.bincount(cells, weights=x.value[left] * y.value[right], minlength=out.size).reshape(out.shape)


def _sparse_block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int, exclude_self: bool):
    """Squared Euclidean distance of unit rows; an empty row has length zero."""
    parts, dots, q_step, c_step = [], _dots, _QUERIES, _CANDIDATES
    asked, asked_ids = _Postings(queries), queries["row_id"].to_numpy()
    if asked.repeats() or any(
            _Postings(candidates.iloc[at:at + c_step]).repeats() for at in range(0, len(candidates), c_step)):
        dots, q_step, c_step = _repeated_dots, _STEP, _STEP
    # The lists and the matrix of one piece of the candidates are held at a time.
    for begin in range(0, len(candidates), c_step):
        piece = candidates.iloc[begin:begin + c_step]
        c_ids, c = piece["row_id"].to_numpy(), _Postings(piece)
        for at in range(0, len(queries), q_step):
            q_ids, q = asked_ids[at:at + q_step], asked.some(at, at + q_step)
            d = dots(q, c)
            d *= -2.0
            d += c.lengths
            d += q.lengths[:, None]
            if exclude_self:
                d[q_ids[:, None] == c_ids[None, :]] = np.inf
            rows, cols, distance = _best(d, lambda r, c: d[r, c], c_ids, k, 1e-9)
            parts.append(pd.DataFrame({
                "query_id": q_ids[rows], "neighbour_id": c_ids[cols],
                "distance": np.maximum(distance, 0.0)}))
    return _collect(parts, k)


def _blocked(queries: DataFrame, candidates: DataFrame, group: list[str], k: int,
             block: Callable, exclude_self: bool, block_rows: int) -> DataFrame:
    def blocks_of(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*group).agg(
            F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name)
        )

    grid = blocks_of(queries, "_nq").join(blocks_of(candidates, "_nc"), group)
    home = lambda count: F.pmod(F.xxhash64("row_id"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    cut_queries = queries.join(grid, group).withColumns({"_q": home("_nq"), "_c": every("_nc")})
    cut_candidates = candidates.join(grid, group).withColumns(
        {"_c": home("_nc"), "_q": every("_nq")})
    keys = [*group, "_q", "_c"]
    types = dict(queries.dtypes)
    schema = ", ".join(
        [f"{g} {types[g]}" for g in group]
        + ["query_id bigint", "neighbour_id bigint", "distance double"]
    )

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = [*group, "query_id", "neighbour_id", "distance"]
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in columns})
        found = block(left, right.rename(columns=plain), k, exclude_self)
        pa.default_memory_pool().release_unused()  # a worker that waits holds no more than it must
        for g in group:
            found[g] = left[g].iloc[0]
        return found[columns]

    # Fresh names on one side: both may come from the same table.
    plain = {f"c_{c}": c for c in [*candidates.columns, "_q", "_c"]}
    renamed = cut_candidates.select(*[F.col(c).alias(n) for n, c in plain.items()])
    return cut_queries.drop("_nq", "_nc").groupBy(*keys).cogroup(
        renamed.groupBy(*[f"c_{c}" for c in keys])
    ).applyInPandas(nearest, schema)


_ORDER = ["distance", "neighbour_id"]
#: Times that a round may send the rows of both sides to blocks, on average.
ROUND_COPIES = 2


def _rounds(queries: DataFrame, candidates: DataFrame, group: list[str], block_rows: int) -> int:
    """In how many rounds the queries are taken, so that one round's blocks stay near the input's size.

    Every row goes to as many blocks as the other side of its group has; all at once that
    grows with the product of both sides. A round shares the queries' blocks out.
    """
    size = lambda df, name: df.groupBy(*group).agg(F.count(F.lit(1)).alias(name))
    q, c = F.col("_rq"), F.col("_rc")
    blocks = lambda n: F.ceil(n / block_rows)
    sent = size(queries, "_rq").join(size(candidates, "_rc"), group).agg(
        F.sum(q * blocks(c) + c * blocks(q)).alias("copies"), F.sum(q + c).alias("rows"),
        F.max(blocks(q)).alias("most")).first()
    if not sent["rows"]:
        return 1
    return max(1, min(sent["most"], -(-sent["copies"] // (ROUND_COPIES * sent["rows"]))))


def knn_sparse(queries: DataFrame, candidates: DataFrame, group: list[str],
               k: int = lexicon.NEIGHBOURS, exclude_self: bool = False,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """k nearest unit TF-IDF rows inside ``group``.

    Both sides carry ``group``, ``row_id``, ``idx`` and ``val``. Returns
    ``group, query_id, neighbour_id, distance, rank``.
    """
    columns = [*group, "row_id", "idx", "val"]
    queries, candidates = queries.select(*columns), candidates.select(*columns)

    def best(asked: DataFrame) -> DataFrame:
        found = _blocked(asked, candidates, group, k, _sparse_block, exclude_self, block_rows)
        return top_k(found, [*group, "query_id"], [F.col(c) for c in _ORDER], k)

    rounds = _rounds(queries, candidates, group, block_rows)
    if rounds == 1:
        return best(queries)
    # Each round is written, and its shuffle files are gone before the next one begins.
    turn = F.pmod(F.xxhash64(F.lit(rounds), "row_id"), F.lit(rounds))
    parts = [stage(best(queries.filter(turn == at)), "neighbour_round") for at in range(rounds)]
    return reduce(DataFrame.unionByName, parts)


class _Cells:
    """Pivots that cut the candidates into cells, and how far each cell reaches.

    Everything here is a few numbers per pivot, at most ``MAX_CELLS`` pivots.
    """

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.reach = np.full(len(pivots), -np.inf)
        self.sure = np.full(len(pivots), np.inf)

    def distances(self, vectors: pd.Series) -> np.ndarray:
        points = np.stack(vectors.to_numpy()).astype(np.float64)
        out = np.empty((len(points), len(self.pivots)))
        for at, pivot in enumerate(self.pivots):
            out[:, at] = np.sqrt(((points - pivot) ** 2).sum(axis=1))
        return out

    def assign(self, candidates: DataFrame) -> DataFrame:
        cells = self

        @F.pandas_udf("cell int, apart double")
        def nearest(vectors: pd.Series) -> pd.DataFrame:
            apart = cells.distances(vectors)
            return pd.DataFrame({
                "cell": apart.argmin(axis=1).astype("int32"), "apart": apart.min(axis=1)})

        return candidates.withColumn("_a", nearest("vec")).select(
            "_a.cell", "row_id", "vec", "_a.apart")

    def measure(self, assigned: DataFrame, enough: int) -> None:
        """Per cell: its radius, and a radius that surely holds ``enough`` rows."""
        nearest_rows = top_k(assigned.select("cell", "row_id", "apart"), ["cell"],
                             [F.col("apart"), F.col("row_id")], enough, salt_by=["row_id"])
        for row in assigned.groupBy("cell").agg(F.max("apart").alias("far")).collect():
            self.reach[row.cell] = row.far
        for row in nearest_rows.filter(F.col("rank") == enough).collect():
            self.sure[row.cell] = row.apart

    def visit(self, queries: DataFrame) -> DataFrame:
        """Each query with every cell that can hold one of its neighbours.

        Some cell surely has enough rows within ``distance to pivot + sure``.
        By the triangle inequality a cell whose nearest possible row is farther
        than that cannot contribute, so leaving it out loses nothing.
        """
        cells = self

        @F.pandas_udf("array<int>")
        def reachable(vectors: pd.Series) -> pd.Series:
            apart = cells.distances(vectors)
            bound = (apart + cells.sure).min(axis=1)
            slack = 1e-9 * (1.0 + apart.max(axis=1))
            hit = apart - cells.reach <= (bound + slack)[:, None]
            return pd.Series([np.flatnonzero(h).astype("int32") for h in hit])

        return queries.withColumn("cell", F.explode(reachable("vec"))).select(
            "cell", "row_id", "vec")


MAX_CELLS = 64


def knn_vectors(queries: DataFrame, candidates: DataFrame, k: int = lexicon.RETRIEVED,
                exclude_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """k nearest dense vectors by squared L2 distance, exact.

    Both sides carry ``row_id`` and ``vec``. Returns
    ``query_id, neighbour_id, distance, rank``. More than one block of
    candidates is first cut into cells around pivots, and a query visits only
    the cells that can matter.
    """
    queries, candidates = queries.select("row_id", "vec"), candidates.select("row_id", "vec")
    count = candidates.count()
    wanted = min(MAX_CELLS, -(-count // block_rows))
    if wanted <= 1:
        # One cell for all, computed from the row: a literal key would turn the
        # joins on it into nested loops.
        only = F.pmod(F.col("row_id"), F.lit(1)).cast("int").alias("cell")
        sides = queries.select(only, "row_id", "vec"), candidates.select(only, "row_id", "vec")
    else:
        sample = candidates.orderBy(F.md5(F.col("row_id").cast("string"))).limit(wanted)
        cells = _Cells(np.array([row.vec for row in sample.collect()], dtype=np.float64))
        assigned = cells.assign(candidates)
        cells.measure(assigned, k + int(exclude_self))
        sides = cells.visit(queries), assigned.drop("apart")
    found = _blocked(*sides, ["cell"], k, _dense_block, exclude_self, block_rows)
    return top_k(found.drop("cell"), ["query_id"], [F.col(c) for c in _ORDER], k)


#: Candidates, at most, that set where the hyperplanes of ``knn_lsh`` lie.
SAMPLE_ROWS = 1024


class _Planes:
    """Random hyperplanes of some hash tables, each through the median of a sample."""

    def __init__(self, sample: np.ndarray, tables: int, bits: int):
        draw = np.random.default_rng(lexicon.SEED)
        self.tables, self.bits = tables, bits
        self.directions = draw.standard_normal((sample.shape[1], tables * bits))
        self.medians = np.median(sample @ self.directions, axis=0)

    def cells(self, vectors: pd.Series, probes: int) -> pd.Series:
        """Per vector its bucket in every table, then those behind its nearest planes."""
        points = np.stack(vectors.to_numpy()).astype(np.float64)
        margin = (points @ self.directions - self.medians).reshape(len(points), self.tables, self.bits)
        worth = np.left_shift(1, np.arange(self.bits))
        home = ((margin > 0) * worth).sum(axis=2) + (np.arange(self.tables) << self.bits)
        near = np.argsort(np.abs(margin), axis=2, kind="stable")[:, :, :probes]
        codes = np.concatenate([home[:, :, None], home[:, :, None] ^ worth[near]], axis=2)
        return pd.Series(list(codes.reshape(len(points), -1)))


def knn_lsh(queries: DataFrame, candidates: DataFrame, k: int = lexicon.RETRIEVED,
            exclude_self: bool = False, tables: int = 8, probes: int = 6,
            bucket_rows: int = 256, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """k nearest dense vectors, approximate: only rows of probed buckets are compared.

    Same columns as ``knn_vectors``; distances are exact. Every candidate lies in one
    bucket of each table; bits grow with the candidates so that an average bucket holds
    about ``bucket_rows``. A query visits its bucket and those behind its ``probes``
    nearest planes. A bucket of any size is cut into blocks, none is capped. Rows
    without a vector take no part; a query whose buckets are empty has no neighbours.
    """
    queries, candidates = [
        side.select("row_id", "vec").filter("vec IS NOT NULL") for side in (queries, candidates)]
    count = candidates.count()
    bits = max(1, int(np.ceil(np.log2(max(count, 1) / bucket_rows))))
    drawn = candidates.orderBy(F.xxhash64("row_id"), "row_id").limit(SAMPLE_ROWS).collect()
    if not drawn:
        queries = queries.limit(0)
    sample = np.array([row.vec for row in drawn] or [[0.0]], dtype=np.float64)
    planes = _Planes(sample, tables, bits)

    def bucketed(side: DataFrame, flips: int) -> DataFrame:
        @F.pandas_udf("array<bigint>")
        def cells(vectors: pd.Series) -> pd.Series:
            return planes.cells(vectors, flips)

        return side.select(F.explode(cells("vec")).alias("cell"), "row_id", "vec")

    found = _blocked(bucketed(queries, probes), bucketed(candidates, 0), ["cell"], k,
                     _dense_block, exclude_self, block_rows)
    # Tables overlap: a pair found in several of them has one distance.
    once = found.drop("cell").distinct()
    return top_k(once, ["query_id"], [F.col(c) for c in _ORDER], k)


def attach_rows(neighbours: DataFrame, rows: DataFrame, on: list[str] = ()) -> DataFrame:
    """Neighbour ids to neighbour rows; ``rows`` carries ``row_id``."""
    return neighbours.join(rows.withColumnRenamed("row_id", "neighbour_id"), [*on, "neighbour_id"])
