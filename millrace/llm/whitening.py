"""Whitening of embeddings through the exact characteristic polynomial of their scatter.

The scatter of integer vectors is an integer matrix, summed exactly by Spark. Its characteristic
polynomial is found modulo many primes, one Hessenberg reduction each, spread over tasks, and put
together by the Chinese remainder theorem. A symmetric matrix has real roots only, so the number of roots
above a point is the number of sign changes of the polynomial shifted there; bisection with this exact
count isolates the largest roots to many more digits than a double holds, and tells how often each occurs.
Their components span the null space of the scatter less the root and are found by inverse iteration in
long decimals.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import arrow_schema, stored
from millrace.llm.registry import query, table
from millrace.llm.vectors import exactly, integer_vector, matrix, usable

COMPONENTS = 4

ROOT_BITS = 112
"""Roots are isolated to the largest one divided by 2 to this power."""

PRIME_BELOW = 1 << 31
"""Products of two residues fit into 62 bits."""

LOW_BITS = 40
"""Sums of products travel in two parts, so that decimals hold them whatever the entries."""

SLICE = 4096
"""Vectors a task multiplies at once."""


# Polynomials


def primes(count_until) -> list[int]:
    """The largest primes below `PRIME_BELOW`, as many as `count_until(product)` asks for, and one more."""
    sieve = np.ones(isqrt(PRIME_BELOW) + 1, dtype=bool)
    sieve[:2] = False
    for k in range(2, isqrt(len(sieve)) + 1):
        if sieve[k]:
            sieve[k * k :: k] = False
    small = np.flatnonzero(sieve)
    found, product, candidate = [], 1, PRIME_BELOW - 1
    while not found or not count_until(product // found[-1]):
        if (candidate % small).all():
            found.append(candidate)
            product *= candidate
        candidate -= 2
    return found


def hessenberg_mod(values: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to `values` modulo `p`, zero below the first subdiagonal."""
    a = values.copy()
    for k in range(1, len(a) - 1):
        below = np.flatnonzero(a[k:, k - 1])
        if not len(below):
            continue
        at = k + int(below[0])
        if at != k:
            a[[k, at]] = a[[at, k]]
            a[:, [k, at]] = a[:, [at, k]]
        factor = a[k + 1 :, k - 1] * pow(int(a[k, k - 1]), -1, p) % p
        a[k + 1 :] = (a[k + 1 :] - factor[:, None] * a[k] % p) % p
        a[:, k] = (a[:, k] + (a[:, k + 1 :] * factor % p).sum(axis=1)) % p
    return a


def polynomial_mod(rows: list[list[int]], p: int) -> list[int]:
    """Characteristic polynomial of an integer matrix modulo `p`, constant term first."""
    d = len(rows)
    h = hessenberg_mod(np.array([[v % p for v in row] for row in rows], np.int64).reshape(d, d), p)
    found = np.zeros((d + 1, d + 1), np.int64)
    found[0, 0] = 1
    for m in range(1, d + 1):
        next_ = np.zeros(d + 1, np.int64)
        next_[1:] = found[m - 1, :-1]
        next_ -= h[m - 1, m - 1] * found[m - 1] % p
        chain, weights = 1, np.zeros(m - 1, np.int64)
        for i in range(m - 1, 0, -1):
            chain = chain * int(h[i, i - 1]) % p
            weights[i - 1] = int(h[i - 1, m - 1]) * chain % p
        next_ -= (weights[:, None] * found[: m - 1] % p).sum(axis=0)
        found[m] = next_ % p
    return found[d].tolist()


def remainders_joined(residues: dict[int, list[int]]) -> list[int]:
    """The integers nearest to zero with the given residues."""
    product = 1
    for p in residues:
        product *= p
    total = [0] * len(next(iter(residues.values())))
    for p, own in residues.items():
        rest = product // p
        unit = rest * pow(rest, -1, p)
        total = [t + r * unit for t, r in zip(total, own)]
    total = [t % product for t in total]
    return [t - product if 2 * t > product else t for t in total]


def coefficient_bound(d: int, trace: int) -> int:
    """No coefficient of the polynomial of a positive semidefinite matrix is larger: the elementary
    symmetric functions of its roots are largest when all roots are equal."""
    mean = trace // max(d, 1) + 1
    return max(comb(d, k) * mean**k for k in range(d + 1))


def characteristic_polynomial(spark: SparkSession, rows: list[list[int]]) -> list[int]:
    """Of a positive semidefinite integer matrix, constant term first; each prime is a task's work. The
    last prime is not needed to tell the coefficients and checks them."""
    d = len(rows)
    bound = coefficient_bound(d, sum(rows[i][i] for i in range(d)))
    chosen = primes(lambda product: product > 2 * bound)

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), pa.array([polynomial_mod(rows, p) for p in own], pa.list_(pa.int64()))],
                names=["prime", "coefficients"],
            )

    work = spark.createDataFrame([(p,) for p in chosen], "prime bigint")
    found = {r[0]: r[1] for r in work.mapInArrow(run, "prime bigint, coefficients array<bigint>").collect()}
    check = found.pop(chosen[-1])
    joined = remainders_joined(found)
    if [c % chosen[-1] for c in joined] != list(check):
        raise ArithmeticError("the residues of the characteristic polynomial do not fit together")
    return joined


# Roots


def roots_above(coefficients: list[int], point: int) -> int:
    """How many roots of a polynomial with real roots only are larger than `point`, repeats counted: the
    sign changes in the coefficients of the polynomial shifted by `point`."""
    shifted = coefficients[::-1]
    n = len(shifted)
    for end in range(n, 1, -1):
        for i in range(1, end):
            shifted[i] += point * shifted[i - 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


@dataclass(frozen=True)
class Root:
    """`times` roots lie in (`at`, `at` + 1], in units of 1 / 2**`bits`."""

    at: int
    bits: int
    times: int

    @property
    def middle(self) -> Fraction:
        return Fraction(2 * self.at + 1, 1 << (self.bits + 1))


def largest_roots(coefficients: list[int], count: int, root_bits: int = ROOT_BITS) -> list[Root]:
    """The largest positive roots, falling, until `count` of them are covered or no positive one is left."""
    d = len(coefficients) - 1
    positive = roots_above(coefficients, 0)
    if not positive:
        return []
    top = 1
    while roots_above(coefficients, top):
        top *= 2
    bits = max(0, root_bits - top.bit_length())
    scaled = [c << (bits * (d - k)) for k, c in enumerate(coefficients)]
    known = {0: positive, top << bits: 0}
    out: list[Root] = []
    covered = 0
    while covered < min(count, positive):
        # The next root is the one with exactly `covered` larger ones.
        low = max(x for x, above in known.items() if above > covered)
        high = min(x for x, above in known.items() if above <= covered)
        while high - low > 1:
            middle = (low + high) // 2
            known[middle] = roots_above(scaled, middle)
            if known[middle] > covered:
                low = middle
            else:
                high = middle
        times = known[low] - known[high]
        out.append(Root(low, bits, times))
        covered += times
    return out


# Components


def _decimal(value: Fraction) -> Decimal:
    return Decimal(value.numerator) / Decimal(value.denominator)


def null_space(rows: list[list[int]], root: Root, root_bits: int = ROOT_BITS) -> np.ndarray:
    """Orthonormal vectors, one for each time the root occurs, of the matrix less the root."""
    d = len(rows)
    with localcontext() as context:
        context.prec = 30 + 2 * root_bits * 302 // 1000
        shift = _decimal(root.middle)
        whole = np.array([[Decimal(v) for v in row] for row in rows], dtype=object).reshape(d, d)
        a = whole.copy()
        a[np.arange(d), np.arange(d)] -= shift
        order = np.arange(d)
        tiny = Decimal(1) / Decimal(1 << (root.bits + 2 * root_bits))
        for k in range(d):
            at = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            a[[k, at]], order[[k, at]] = a[[at, k]], order[[at, k]]
            if not a[k, k]:
                a[k, k] = tiny
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] -= np.multiply.outer(a[k + 1 :, k], a[k, k + 1 :])

        def solve(right: np.ndarray) -> np.ndarray:
            x = right[order].copy()
            for k in range(1, d):
                x[k] -= (a[k, :k] * x[:k]).sum()
            for k in range(d - 1, -1, -1):
                x[k] = (x[k] - (a[k, k + 1 :] * x[k + 1 :]).sum()) / a[k, k]
            return x

        draw = np.random.RandomState(0)
        found = [np.array([Decimal(int(v)) for v in draw.randint(1, 1 << 30, d)], dtype=object) for _ in range(root.times)]
        for _ in range(3):
            made: list[np.ndarray] = []
            for v in found:
                v = solve(v)
                for _ in range(2):
                    v = v / (v * v).sum().sqrt()
                    for u in made:
                        v = v - u * (u * v).sum()
                made.append(v / (v * v).sum().sqrt())
            found = made
        out = np.array([[float(c) for c in v] for v in found])
    # Either sign is a component; the largest entry is made positive.
    return out * np.sign(out[np.arange(len(out)), np.abs(out).argmax(axis=1)])[:, None]


# The operator


@dataclass(frozen=True)
class Whitening:
    """Fitted to `n` different vectors with the sums `sums`; one entry of `values` (eigenvalues of the
    covariance), `explained` and `components` for each component."""

    n: int
    sums: list[int]
    polynomial: list[int]
    values: list[float]
    explained: list[float]
    components: np.ndarray
    identity_error: float

    @property
    def dimensions(self) -> int:
        return len(self.sums)

    def project(self):
        """Function from integer rows to whitened ones."""
        mean = np.array([float(Fraction(s, self.n)) for s in self.sums])
        basis = self.components.T / np.sqrt(np.array(self.values))
        return lambda x: (x - mean) @ basis


def scatter_sums(vectors: DataFrame, dimensions: int) -> tuple[int, list[int], list[list[int]]]:
    """(rows, sums, sums of products) of an integer vector column `x`, exact. A task sends one row for each
    pair of dimensions."""
    schema = T.StructType(
        [T.StructField(c, T.IntegerType()) for c in "ij"]
        + [T.StructField(c, T.DecimalType(38, 0)) for c in ("high", "low")]
    )
    out = arrow_schema(schema)
    pairs = [(i, j) for i in range(dimensions + 1) for j in range(i, dimensions + 1)]

    def run(batches):
        total = np.zeros((dimensions + 1, dimensions + 1), dtype=object)
        for batch in batches:
            x = matrix(batch.column(0))
            for start in range(0, len(x), SLICE):
                part = x[start : start + SLICE]
                # A last entry of 1 gives the sums and the number of rows as products too.
                held = exactly(np.concatenate([part, np.ones((len(part), 1), np.int64)], axis=1), len(part))
                own = held.T @ held
                total = total + (own.astype(np.int64) if own.dtype == np.float64 else own).astype(object)
        values = [int(total[i, j]) for i, j in pairs]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in pairs], pa.int32()),
                pa.array([j for _, j in pairs], pa.int32()),
                pa.array([Decimal(v >> LOW_BITS) for v in values], out.field("high").type),
                pa.array([Decimal(v & ((1 << LOW_BITS) - 1)) for v in values], out.field("low").type),
            ],
            schema=out,
        )

    summed = vectors.select("x").mapInArrow(run, schema).groupBy("i", "j").agg(F.sum("high"), F.sum("low")).collect()
    d, full = dimensions, {}
    for i, j, high, low in summed:
        full[i, j] = full[j, i] = (int(high) << LOW_BITS) + int(low)
    n = full.get((d, d), 0)
    return n, [full.get((i, d), 0) for i in range(d)], [[full.get((i, j), 0) for j in range(d)] for i in range(d)]


def fit_whitening(spark: SparkSession, vectors: DataFrame, vector: str, components: int = COMPONENTS) -> Whitening:
    """Fit to each different vector of the integer array column `vector` once.

    Vectors of the length that most different vectors have take part (of several such lengths, the longest).
    An empty table, empty vectors and vectors without any spread give no components; so do directions
    without spread: there are as many components as positive eigenvalues, at most `components`. Equal
    eigenvalues get orthogonal components. A matrix of d dimensions passes through the driver (d * d
    integers); work there grows with the cube of d, not with the rows.
    """
    fit = stored(spark, vectors.select(F.col(vector).alias("x")).where("x is not null").distinct(), "fit-list")
    lengths = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None or lengths[0] == 0:
        return Whitening(0, [], [1], [], [], np.zeros((0, 0)), 0.0)
    d = lengths[0]
    fit = fit.where(F.size("x") == d)
    n, sums, products = scatter_sums(fit, d)
    scatter = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace = sum(scatter[i][i] for i in range(d))
    polynomial = characteristic_polynomial(spark, scatter)
    roots = largest_roots(polynomial, components)
    found = [(r, v) for r in roots for v in null_space(scatter, r)][:components]
    model = Whitening(
        n,
        sums,
        polynomial,
        [float(r.middle / n**2) for r, _ in found],
        [float(r.middle / trace) for r, _ in found],
        np.array([v for _, v in found]).reshape(len(found), d),
        0.0,
    )
    return Whitening(*[getattr(model, f) for f in model.__dataclass_fields__][:-1], _identity_error(fit, model))


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest difference between the covariance of the whitened fit list and the identity."""
    k = len(model.values)
    if not k:
        return 0.0

    def run(batches):
        project, total = model.project(), np.zeros((k, k))
        for batch in batches:
            x = matrix(batch.column(0))
            for start in range(0, len(x), SLICE):
                y = project(x[start : start + SLICE])
                total += y.T @ y
        ij = np.arange(k * k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a) for a in ((ij // k).astype(np.int32), (ij % k).astype(np.int32), total.ravel())],
            names=["i", "j", "v"],
        )

    summed = fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect()
    return max(abs(v / model.n - (i == j)) for i, j, v in summed)


def whiten(rows: DataFrame, row_id: str, vector: str, model: Whitening) -> DataFrame:
    """`row_id`, `component` (from 1), `deviation` (sum of (n * x - S) squared, exact; NULL from 39 digits on)
    and `whitened` of every row whose integer vector is as long as the fitted ones. Rows without a vector
    or with one of another length give no rows; repeated rows and NULL ids are kept."""
    schema = T.StructType(
        [
            T.StructField(row_id, rows.schema[row_id].dataType),
            T.StructField("component", T.IntegerType()),
            T.StructField("deviation", T.DecimalType(38, 0)),
            T.StructField("whitened", T.DoubleType()),
        ]
    )
    out = arrow_schema(schema)
    k, d, n = len(model.values), model.dimensions, model.n

    def run(batches):
        project = model.project()
        sums = np.array(model.sums, dtype=object)
        most = max((abs(s) for s in model.sums), default=0)
        base = sum(s * s for s in model.sums)
        for batch in batches:
            ids, x = batch.column(0), matrix(batch.column(1))
            if not len(x):
                continue
            own = exactly(x, d)
            squares = (own * own).sum(axis=1)
            own = exactly(x, d, most)
            across = own @ (sums.astype(np.float64) if own.dtype == np.float64 else sums)
            exact = [n * n * int(q) - 2 * n * int(r) + base for q, r in zip(squares, across)]
            exact = pa.array([Decimal(v) if v < 10**38 else None for v in exact], out.field("deviation").type)
            which = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(which),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    exact.take(which),
                    pa.array(project(x.astype(np.float64)).ravel()),
                ],
                schema=out,
            )

    fits = F.size(vector) == d
    return rows.where(fits if k else F.lit(False)).select(row_id, vector).mapInArrow(run, schema)


@query("op11_polynomial_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose vector is NULL or holds NULL, NaN or infinite entries are left out; other columns are not
    read. A deviation that a long cannot hold is NULL."""
    rows = table(spark, folder, "embeddings")
    held = rows.where(usable(F.col("embedding"))).select("vec_id", integer_vector(F.col("embedding")).alias("x"))
    model = fit_whitening(spark, held, "x")
    value = F.lit(0.0)
    for i, share in enumerate(model.explained, 1):
        value = F.when(F.col("component") == i, F.lit(share)).otherwise(value)
    return whiten(held, "vec_id", "x", model).select(
        "vec_id",
        "component",
        F.lit(model.n).cast("bigint").alias("n"),
        F.col("deviation").try_cast("bigint").alias("deviation"),
        "whitened",
        value.alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
