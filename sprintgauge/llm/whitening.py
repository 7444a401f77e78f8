"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Vectors become integers ``x = floor(1024 * c) + 100000``, so the scatter
``M = n * sum(y y') - (sum y)(sum y)'`` with ``y`` the centred ``x`` is an exact
integer matrix, ``n * n`` times the covariance.

1. Counts, sums and then products of centred entries are added up exactly in tasks.
2. The characteristic polynomial of ``M`` is found modulo many primes by Hessenberg
   reduction, primes spread over tasks, and put together by Chinese remaindering.
3. All roots are real, so the sign changes of the polynomial shifted to ``a`` count
   exactly the roots beyond ``a``: bisection isolates each of the largest roots and
   refines it to ``EXTRA_BITS`` bits behind the binary point.
4. Inverse iteration on ``M - root`` in long decimals gives the null vector, one task
   per root. Roots that stay together are one root: its vectors are made orthogonal.
5. A last pass projects every row; the covariance of what comes out is measured too.

Only what has the size of the matrix reaches the driver, never rows.

Defined results: vectors that are null, empty, of another length than the commonest
(the greater of equals), or that hold a null, non-finite or, at 2**40 and more,
unrepresentable entry are left out of the fit and of the result; repeated ids and rows
count each, a null id stays null. Directions without variance are no components, so
one row or equal rows give no rows, as does an empty table. A deviation beyond a long
is null. Components of one repeated root span its space; each vector's largest entry
is positive. Only the id and vector columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Context, Decimal, localcontext
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
LARGEST = float(1 << 40)
#: Bits behind the point to which a root of the integer scatter is refined.
EXTRA_BITS = 128
_MAX_LONG = (1 << 63) - 1


class Fit(NamedTuple):
    """What the rows are projected with; ``axes`` has one column per component."""

    n: int
    sums: list[int]
    roots: list[Fraction]
    axes: np.ndarray
    trace: int


def _vectors(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that count and their integer vectors."""
    lists = batch.column("vector")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.cast(pa.float64())
    bad = ~np.isfinite(v := values.fill_null(np.nan).to_numpy(zero_copy_only=False)) | (np.abs(v) >= LARGEST)
    before = np.concatenate([[0], np.cumsum(bad)])
    here = lists.is_valid().to_numpy(zero_copy_only=False)
    good = np.flatnonzero(here & (np.diff(offsets) == dim) & (before[offsets[1:]] == before[offsets[:-1]]))
    x = np.floor(SCALE * v[offsets[good][:, None] + np.arange(dim)]).astype(np.int64) + OFFSET
    return good, x


def _rows(table: DataFrame, vector: str, *keep: str) -> DataFrame:
    return table.select(*keep, F.col(vector).cast("array<double>").alias("vector"))


def _dimension(rows: DataFrame) -> int:
    """The commonest length of usable vectors, 0 without any."""
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST))
    sizes = rows.filter((F.size("vector") > 0) & ~bad).groupBy(F.size("vector").alias("d")).count()
    best = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return best.d if best else 0


def _totals(rows: DataFrame, dim: int, centre: list[int] | None) -> tuple[int, dict[tuple[int, int], int]]:
    """Exact number of rows and sums, of entries (no centre) or of products of centred entries.

    An entry is below 2**51; products are added up in pieces of 26 bits, so that the
    sums of a batch fit longs whatever the vectors hold.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            _, x = _vectors(batch, dim)
            n += len(x)
            for begin in range(0, len(x), 1024):
                y = x[begin:begin + 1024]
                if centre is None:
                    part = y.sum(axis=0).astype(object)[None, :]
                else:
                    y = y - np.array(centre, dtype=np.int64)
                    high, low = y >> 26, y & ((1 << 26) - 1)
                    cross = (high.T @ low).astype(object)
                    part = ((high.T @ high).astype(object) << 52) + ((cross + cross.T) << 26) + (low.T @ low).astype(object)
                total = part if total is None else total + part
        if n:
            i, j = np.triu_indices(dim) if centre is not None else (np.zeros(dim, dtype=int), np.arange(dim))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), n), pa.int64()),
                 *[pa.array([Decimal(part(int(total[a, b]))) for a, b in zip(i, j)], pa.decimal128(38, 0))
                   for part in (lambda v: v >> 52, lambda v: v & ((1 << 52) - 1))]], ["i", "j", "n", "high", "low"])

    parts = rows.select("vector").mapInArrow(run, "i int, j int, n long, high decimal(38,0), low decimal(38,0)")
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).collect()  # the matrix
    return (sums[0].n if sums else 0), {(r.i, r.j): (int(r.high) << 52) + int(r.low) for r in sums}


def scatter(rows: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """``n``, the sums of ``x`` and the exact integer ``n * n`` times the covariance."""
    n, sums = _totals(rows, dim, None)
    if not n:
        return 0, [], []
    sums = [sums[0, j] for j in range(dim)]
    centre = [s // n for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    products = _totals(rows, dim, centre)[1]
    full = [[n * products[min(i, j), max(i, j)] - rest[i] * rest[j] for j in range(dim)] for i in range(dim)]
    return n, sums, full


def _is_prime(n: int) -> bool:
    """Exact for all n below 2**32."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes(bits: int) -> list[int]:
    """Primes below 2**31 whose product has more than ``bits`` bits."""
    out, n, have = [], (1 << 31) - 1, 0.0
    while have <= bits + 2:
        if _is_prime(n):
            out.append(n)
            have += math.log2(n)
        n -= 2
    return out


def polynomial_mod(matrix: list[list[int]], p: int) -> np.ndarray:
    """Coefficients of ``det(x - matrix)`` modulo ``p``, constant first."""
    d = len(matrix)
    a = np.array([[v % p for v in row] for row in matrix], dtype=np.int64)
    for m in range(1, d - 1):
        rows = np.flatnonzero(a[m:, m - 1])
        if not len(rows):
            continue
        pivot = m + int(rows[0])
        a[[m, pivot]] = a[[pivot, m]]
        a[:, [m, pivot]] = a[:, [pivot, m]]
        u = a[m + 1:, m - 1] * pow(int(a[m, m - 1]), -1, p) % p
        a[m + 1:] = (a[m + 1:] - u[:, None] * a[m] % p) % p
        a[:, m] = (a[:, m] + (a[:, m + 1:] * u % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), dtype=np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros(d + 1, dtype=np.int64)
        new[1:] = polys[k - 1, :-1]
        new = (new - a[k - 1, k - 1] * polys[k - 1]) % p
        below = 1
        for i in range(k - 1, 0, -1):
            below = below * int(a[i, i - 1]) % p
            if not below:
                break
            new = (new - int(a[i - 1, k - 1]) * below % p * polys[i - 1]) % p
        polys[k] = new
    return polys[d]


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients of ``det(x - matrix)``, constant first, for a matrix without negative roots."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # The sizes of the coefficients add up to the product of 1 + root, at most (1 + trace / d) ** d.
    bits = math.ceil(d * math.log2(1 + Fraction(trace, d))) + 1
    ps = primes(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("p").to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p]), pa.array([polynomial_mod(matrix, p).tolist()], pa.list_(pa.int64()))], ["p", "c"])

    tasks = spark.createDataFrame([(p,) for p in ps], "p long").repartition(min(len(ps), 64))
    found = {r.p: r.c for r in tasks.mapInArrow(run, "p long, c array<long>").collect()}
    whole = math.prod(ps)
    shares = [(p, whole // p * pow(whole // p, -1, p)) for p in ps]
    out = []
    for k in range(d + 1):
        c = sum(found[p][k] * share for p, share in shares) % whole
        out.append(c - whole if 2 * c > whole else c)
    return out


class Roots:
    """Largest positive roots of an integer polynomial that has only real roots."""

    def __init__(self, coefficients: list[int]):
        self.zeros = next(i for i, c in enumerate(coefficients) if c)
        self.c = coefficients[self.zeros:]
        self.degree = len(self.c) - 1

    def _scaled(self, bits: int) -> list[int]:
        """The polynomial whose roots are those of this one times ``2 ** bits``."""
        return [c << bits * (self.degree - k) for k, c in enumerate(self.c)]

    def beyond(self, a: int, bits: int = 0) -> int:
        """How many roots are greater than ``a / 2 ** bits``, each as often as it occurs."""
        c = self._scaled(bits)
        for i in range(self.degree):
            for k in range(self.degree - 1, i - 1, -1):
                c[k] += a * c[k + 1]
        signs = [x > 0 for x in c if x]
        return sum(x != y for x, y in zip(signs, signs[1:]))

    def _positive(self, a: int, scaled: list[int]) -> bool:
        value = 0
        for c in reversed(scaled):
            value = value * a + c
        return value > 0

    def largest(self, count: int, bits: int = EXTRA_BITS) -> list[tuple[Fraction, int]]:
        """``(root, how often)`` of the largest roots, at least ``count`` of them where there are."""
        most = 1 << max(self.c[-2].__abs__().bit_length(), 1) if self.degree else 1
        seen = {0: self.degree, most: 0}  # the trace is beyond all roots
        count = min(count, self.degree)
        out: list[tuple[Fraction, int]] = []
        done = 0
        while done < count:
            # The interval (low, high] that holds root number ``done + 1``.
            low = max(a for a, more in seen.items() if more > done)
            high = min(a for a, more in seen.items() if more <= done)
            while high - low > 1:
                middle = (low + high) // 2
                seen[middle] = self.beyond(middle)
                low, high = (middle, high) if seen[middle] > done else (low, middle)
            out += self._refined(low, seen[low], done, bits)
            done = sum(m for _, m in out)
        return out

    def _refined(self, low: int, above: int, done: int, bits: int) -> list[tuple[Fraction, int]]:
        """All roots in ``(low, low + 1]``, numbers ``done + 1`` to ``above``, the greatest first."""
        scaled = self._scaled(bits)
        out = []
        while done < above:
            a, b, inside = low << bits, (low + 1) << bits, above - done
            if out:
                b = int(out[-1][0] * (1 << bits)) - 1
                inside = self.beyond(a, bits) - done
            while b - a > 1:
                middle = (a + b) // 2
                if inside == 1:
                    # One root of changing sign: positive above it if an even number lies beyond.
                    right = self._positive(middle, scaled) == (done % 2 == 0)
                    a, b = (a, middle) if right else (middle, b)
                else:
                    more = self.beyond(middle, bits)
                    a, b, inside = (middle, b, more - done) if more > done else (a, middle, inside)
            many = self.beyond(a, bits) - done
            out.append((Fraction(b, 1 << bits), many))
            done += many
        return out


def null_vectors(matrix: list[list[int]], root: Fraction, count: int) -> list[list[float]]:
    """``count`` orthogonal unit vectors nearest to the null space of ``matrix - root``."""
    d = len(matrix)
    size = max(1, max(abs(v) for row in matrix for v in row)).bit_length()
    with localcontext(Context(prec=int((2 * size + 2 * EXTRA_BITS) * 0.302) + 20)):
        shift = Decimal(root.numerator) / Decimal(root.denominator)
        a = [[Decimal(v) - shift if i == j else Decimal(v) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
        least = Decimal(2) ** -(2 * EXTRA_BITS)
        order, factors = list(range(d)), []
        for k in range(d):
            pivot = max(range(k, d), key=lambda i: abs(a[i][k]))
            a[k], a[pivot], order[k], order[pivot] = a[pivot], a[k], order[pivot], order[k]
            if abs(a[k][k]) < least:
                a[k][k] = least
            top = a[k]
            for i in range(k + 1, d):
                row = a[i]
                if row[k]:
                    u = row[k] / top[k]
                    row[k + 1:] = [x - u * y for x, y in zip(row[k + 1:], top[k + 1:])]
                    row[k] = u

        def solve(b: list[Decimal]) -> list[Decimal]:
            x = [b[i] for i in order]
            for i in range(d):
                x[i] -= sum((a[i][j] * x[j] for j in range(i)), Decimal(0))
            for i in range(d - 1, -1, -1):
                x[i] = (x[i] - sum((a[i][j] * x[j] for j in range(i + 1, d)), Decimal(0))) / a[i][i]
            return x

        def unit(x: list[Decimal]) -> list[Decimal]:
            for y in out:
                along = sum((p * q for p, q in zip(x, y)), Decimal(0))
                x = [p - along * q for p, q in zip(x, y)]
            norm = sum((p * p for p in x), Decimal(0)).sqrt()
            return [p / norm for p in x]

        out: list[list[Decimal]] = []
        for number in range(count):
            x = unit([Decimal(int(v)) for v in np.random.default_rng(number).integers(1, 1 << 30, d)])
            for _ in range(4):
                x = unit(solve(x))
            if max(x, key=abs) < 0:
                x = [-p for p in x]
            out.append(x)
    return [[float(p) for p in x] for x in out]


def fit(table: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Fit | None:
    """The components of all usable vectors, or None without any variance."""
    spark, rows = table.sparkSession, _rows(table, vector)
    dim = _dimension(rows)
    n, sums, matrix = scatter(rows, dim) if dim else (0, [], [])
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    if not trace:
        return None
    found = Roots(characteristic_polynomial(spark, matrix)).largest(components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("number").to_pylist():
                vectors = null_vectors(matrix, *found[number])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(vectors)), pa.array(vectors, pa.list_(pa.float64()))], ["number", "axis"])

    tasks = spark.createDataFrame([(i,) for i in range(len(found))], "number long").repartition(len(found))
    axes: dict[int, list[list[float]]] = {}
    for r in tasks.mapInArrow(run, "number long, axis array<double>").collect():
        axes.setdefault(r.number, []).append(r.axis)
    pairs = [(root, axis) for i, (root, _) in enumerate(found) for axis in axes[i]][:components]
    return Fit(n, sums, [root for root, _ in pairs], np.array([axis for _, axis in pairs]).T, trace)


def _deviations(y: np.ndarray, n: int, rest: np.ndarray) -> list[int | None]:
    """Exact sums of ``(n * y - rest) ** 2`` per row, None beyond a long."""
    bound = float(n) * (np.abs(y).max(initial=0) + 1)
    if len(rest) * bound * bound < _MAX_LONG:
        return ((n * y - rest) ** 2).sum(axis=1).tolist()
    far = (((n * y.astype(object) - rest) ** 2).sum(axis=1)).tolist()
    return [v if v <= _MAX_LONG else None for v in far]


def project(table: DataFrame, fitted: Fit, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, deviation, whitened`` (one number per component) of each usable row."""
    n, dim = fitted.n, len(fitted.sums)
    centre = np.array([s // n for s in fitted.sums], dtype=np.int64)
    rest = np.array([s - n * (s // n) for s in fitted.sums], dtype=object)
    short = np.array([float(Fraction(int(r), n)) for r in rest])
    scaled = fitted.axes / np.array([math.sqrt(r / (n * n)) for r in fitted.roots])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = _vectors(batch, dim)
            y = x - centre
            white = (y - short) @ scaled
            k = white.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(good)),
                 pa.array(_deviations(y, n, rest.astype(np.int64) if n < 1 << 62 else rest), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * k), pa.array(white.ravel()))],
                ["vec_id", "deviation", "whitened"])

    rows = _rows(table, vector, F.col(id_col).cast("long").alias("id"))
    return rows.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def identity_error(projected: DataFrame, fitted: Fit) -> float:
    """Largest absolute entry of the measured covariance of the whitened rows less the identity."""
    k, n = len(fitted.roots), fitted.n
    at = lambda i: F.get("whitened", F.lit(i))
    sums = projected.agg(*[F.sum(at(i)) for i in range(k)],
                         *[F.sum(at(i) * at(j)) for i in range(k) for j in range(i, k)]).first()
    mean, products = np.array(sums[:k]) / n, iter(sums[k:])
    return max(abs(next(products) / n - mean[i] * mean[j] - (i == j)) for i in range(k) for j in range(i, k))


def whiten(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per row and component."""
    fitted = fit(table, vector, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None:
        return table.sparkSession.createDataFrame([], schema)
    rows = project(table, fitted, id_col, vector)
    explained = F.array(*[F.lit(float(r / fitted.trace)) for r in fitted.roots])
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(float(identity_error(rows, fitted))).alias("identity_error"))
