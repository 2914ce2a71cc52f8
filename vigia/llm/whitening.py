"""Embedding whitening from the exact characteristic polynomial of the integer scatter.

Every entry c of a vector becomes the integer floor(1024 * c) + 100000.  The scatter n * sum(x x') - S S' of n vectors
with sums S is then an integer matrix, n * n times their covariance, and is summed without any rounding.  Its
characteristic polynomial is found modulo many primes by Hessenberg reduction, the primes dealt to the tasks, and put
together by Chinese remaindering.  All its roots are real, so sign variations after a Taylor shift count the roots above
a point exactly; that isolates the largest roots, which are then bisected in integer arithmetic.  Inverse iteration
in fixed point of ``POINT`` bits on the nearly singular shifted scatter gives the components.

Rows stay in Spark: the tasks return sums of a fixed size (dimension squared), which are added by Spark, and each row is
projected where it lies.  The driver handles numbers of one matrix only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.llm.scratch import save

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Entries beyond this size are held at it.
LARGEST = 1 << 61
#: Bits of a limb; products of limbs of ``ROWS`` rows add up exactly in doubles.
LIMB, ROWS = 20, 1 << 13
#: Bits of a digit in which sums travel.
DIGIT = 40
#: Bits behind the point of roots and of vectors, and of the width at which roots that stay together are one.
ROOT, POINT, TOGETHER = 192, 320, 64


# --- integer scatter -------------------------------------------------------

def usable(vector: str):
    """Whether a vector is not null, not empty, and has finite entries only."""
    v = F.col(vector)
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))),
                      F.lit(False))


def as_integers(column: pa.Array, d: int) -> np.ndarray:
    """floor(1024 * c) of every entry, one row per vector (the constant that x has besides cancels in the scatter)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * SCALE), -float(LARGEST), float(LARGEST)).astype(np.int64).reshape(-1, d)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y as a sum of limbs times powers of 2**LIMB, each below 2**LIMB in size, as doubles."""
    out = []
    while y.size and np.abs(y).max() >= 1 << LIMB:
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB
    return [*out, y.astype(np.float64)]


def scatter_sums(batches: Iterator[pa.RecordBatch], d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, the sums and the sums of products of all vectors of a task, as Python integers."""
    n, total, product = 0, np.zeros(d, object), np.zeros((d, d), object)
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            y = as_integers(batch.column("vector").slice(a, ROWS), d)
            parts = limbs(y)
            n += len(y)
            for i, p in enumerate(parts):
                total += p.sum(axis=0).astype(np.int64).astype(object) << (LIMB * i)
                for j, q in enumerate(parts):
                    product += (p.T @ q).astype(np.int64).astype(object) << (LIMB * (i + j))
    return n, total, product


def scatter(rows: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """(n, S without the shift, integer scatter) of the vectors of ``rows``, all of length ``d``.  Tasks send their sums
    in digits of ``DIGIT`` bits, which Spark adds as longs; d * d of them reach the driver."""
    def run(batches):
        n, total, product = scatter_sums(batches, d)
        if not n:
            return
        cell, digit, value = [], [], []
        for at, v in enumerate([n, *total, *(product[i, j] for i in range(d) for j in range(i, d))]):
            sign, v, k = (-1 if v < 0 else 1), abs(int(v)), 0
            while v:
                cell.append(at), digit.append(k), value.append(sign * (v & ((1 << DIGIT) - 1)))
                v, k = v >> DIGIT, k + 1
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(digit, pa.int32()),
                                          pa.array(value, pa.int64())], names=["cell", "digit", "value"])

    got = [0] * (1 + d + d * (d + 1) // 2)
    parts = rows.select("vector").mapInArrow(run, "cell int, digit int, value long")
    for r in parts.groupBy("cell", "digit").agg(F.sum("value").alias("value")).collect():
        got[r["cell"]] += r["value"] << (DIGIT * r["digit"])
    n, s, rest = got[0], got[1:d + 1], iter(got[d + 1:])
    out = np.zeros((d, d), object)
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = n * next(rest) - s[i] * s[j]
    return n, s, out


# --- characteristic polynomial ---------------------------------------------

def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``top`` (at most 2**31), largest first."""
    small = np.ones(1 << 16, bool)
    small[:2] = False
    for i in range(2, 256):
        if small[i]:
            small[i * i::i] = False
    out: list[int] = []
    while len(out) < count:
        lo = max(2, top - (1 << 16))
        block = np.ones(top - lo, bool)
        for p in np.flatnonzero(small).tolist():
            first = max(p * p, -(-lo // p) * p)
            if first < top:
                block[first - lo::p] = False
        out += (lo + np.flatnonzero(block)[::-1]).tolist()
        top = lo
    return out[:count]


def polynomials_mod(matrix: np.ndarray, primes: list[int]) -> np.ndarray:
    """Characteristic polynomial modulo each prime (below 2**31), lowest coefficient first: all primes at once."""
    d, p = len(matrix), np.array(primes, np.int64)
    m = np.stack([(matrix % q).astype(np.int64) for q in primes])
    one, two, at = p[:, None], p[:, None, None], np.arange(len(p))
    for k in range(d - 2):
        pivot = (m[:, k + 1:, k] != 0).argmax(axis=1) + k + 1
        m[at, pivot], m[:, k + 1] = m[:, k + 1].copy(), m[at, pivot].copy()
        m[at, :, pivot], m[:, :, k + 1] = m[:, :, k + 1].copy(), m[at, :, pivot].copy()
        inverse = np.array([pow(int(x), -1, q) if x else 0 for x, q in zip(m[:, k + 1, k], primes)], np.int64)
        u = m[:, k + 2:, k] * inverse[:, None] % one
        m[:, k + 2:] = (m[:, k + 2:] - u[:, :, None] * m[:, None, k + 1] % two) % two
        m[:, :, k + 1] = (m[:, :, k + 1] + (m[:, :, k + 2:] * u[:, None, :] % two).sum(axis=2)) % one
    poly = np.zeros((d + 1, len(p), d + 1), np.int64)
    poly[0, :, 0] = 1
    for k in range(d):
        new = np.roll(poly[k], 1, axis=1) - m[:, k, k, None] * poly[k] % one
        t = np.ones(len(p), np.int64)
        for i in range(k - 1, -1, -1):
            t = t * m[:, i + 1, i] % p
            new -= (t * m[:, i, k] % p)[:, None] * poly[i] % one
        poly[k + 1] = new % one
    return poly[d]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients of det(x - matrix), lowest first, of a positive semidefinite integer matrix.

    With the eigenvalues e, the coefficients are at most binomial(d, k) * (sum(e) / d)**k: enough primes are taken for
    twice that, and one more, whose residues must agree."""
    d, trace = len(matrix), int(sum(matrix[i, i] for i in range(len(matrix))))
    bound = max(math.comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    primes = primes_below(1 << 31, (2 * bound + 1).bit_length() // 30 + 2)
    cells = [str(x) for x in matrix.reshape(-1)]

    def run(batches):
        m = np.array([int(x) for x in cells], object).reshape(d, d)
        for batch in batches:
            mine = batch.column("p").to_pylist()
            for a in range(0, len(mine), 16):
                some = mine[a:a + 16]
                rest = pa.array(polynomials_mod(m, some).tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), rest], names=["p", "rest"])

    tasks = spark.sparkContext.defaultParallelism
    numbers = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(tasks, len(primes)), "p")
    rest = {r["p"]: r["rest"] for r in numbers.mapInArrow(run, "p long, rest array<long>").collect()}
    out, modulus = [0] * (d + 1), 1
    for p in primes[:-1]:
        inverse = pow(modulus, -1, p)
        out = [x + modulus * ((r - x) * inverse % p) for x, r in zip(out, rest[p])]
        modulus *= p
    out = [x - modulus if 2 * x > modulus else x for x in out]
    if any((x - r) % primes[-1] for x, r in zip(out, rest[primes[-1]])):
        raise ArithmeticError("the characteristic polynomial does not agree with the prime that checks it")
    return out


# --- roots -----------------------------------------------------------------

def roots_above(poly: list[int], a: int, s: int) -> int:
    """Number of roots of a real-rooted polynomial above a / 2**s, counted as often as they occur: the sign variations
    of its coefficients after the shift to that point."""
    d = len(poly) - 1
    c = [x << (s * (d - k)) for k, x in enumerate(poly)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += a * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(p != q for p, q in zip(signs, signs[1:]))


def value_at(poly: list[int], a: int, s: int) -> int:
    """2**(s * degree) times the value at a / 2**s."""
    v, d = 0, len(poly) - 1
    for k in range(d, -1, -1):
        v = v * a + (poly[k] << (s * (d - k)))
    return v


def largest_roots(poly: list[int], upper: int, count: int) -> list[tuple[int, int]]:
    """The largest positive roots of a real-rooted polynomial with all roots in [0, upper], as (root * 2**ROOT, how
    often), largest first, until they make up ``count``.  Roots that no width above 2**-TOGETHER parts are one."""
    out: list[tuple[int, int]] = []
    todo = [(0, upper + 1, 0, roots_above(poly, 0, 0), 0)]  # (lo, hi], denominators 2**s, roots above lo and hi
    while todo and sum(m for _, m in out) < count:
        lo, hi, s, n_lo, n_hi = todo.pop()
        if n_lo == n_hi:
            continue
        if n_lo - n_hi == 1:
            lo, hi = lo << (ROOT - s), hi << (ROOT - s)
            above = value_at(poly, hi, ROOT) > 0
            if not value_at(poly, hi, ROOT):
                lo = hi
            while hi - lo > 1:
                mid = (lo + hi) >> 1
                v = value_at(poly, mid, ROOT)
                if not v:
                    lo = hi = mid
                elif (v > 0) == above:
                    hi = mid
                else:
                    lo = mid
            out.append((hi, 1))
        elif hi - lo == 1 and s == TOGETHER:
            out.append((hi << (ROOT - s), n_lo - n_hi))
        else:
            if hi - lo == 1:
                lo, hi, s = lo << 8, hi << 8, s + 8
            mid = (lo + hi) >> 1
            n_mid = roots_above(poly, mid, s)
            todo += [(lo, mid, s, n_lo, n_mid), (mid, hi, s, n_mid, n_hi)]
    return out


# --- components ------------------------------------------------------------

def unit(x: np.ndarray) -> np.ndarray:
    """x scaled to a length of 2**POINT."""
    return (x << POINT) // max(1, math.isqrt(int((x * x).sum())))


def null_space(matrix: np.ndarray, root: int, count: int) -> list[np.ndarray]:
    """``count`` orthonormal vectors (times 2**POINT) that ``matrix - root / 2**ROOT`` takes nearest to zero: inverse
    iteration with elimination in fixed point, where a pivot of zero becomes the smallest number."""
    d = len(matrix)
    m = matrix << POINT
    for i in range(d):
        m[i, i] -= root << (POINT - ROOT)
    order, low = np.arange(d), []
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(m[i, k]))
        m[[k, best]], order[[k, best]] = m[[best, k]], order[[best, k]]
        for f in low:
            f[[k, best]] = f[[best, k]]
        m[k, k] = m[k, k] or 1
        f = np.zeros(d, object)
        f[k + 1:] = (m[k + 1:, k] << POINT) // m[k, k]
        low.append(f)
        m[k + 1:, k:] -= (f[k + 1:, None] * m[None, k, k:]) >> POINT

    def solve(b):
        x = b[order].copy()
        for k in range(d):
            x[k + 1:] -= (low[k][k + 1:] * x[k]) >> POINT
        for k in range(d - 1, -1, -1):
            x[k] = ((x[k] - (int((m[k, k + 1:] * x[k + 1:]).sum()) >> POINT)) << POINT) // m[k, k]
        return x

    span = [unit(np.array([(pow(i + 2, c + 1, 10_007) + 1) for i in range(d)], object)) for c in range(count)]
    for _ in range(3):
        new: list[np.ndarray] = []
        for x in span:
            x = unit(solve(x))
            for _ in range(2):
                for v in new:
                    x = x - ((int((x * v).sum()) >> POINT) * v >> POINT)
                x = unit(x)
            new.append(x)
        span = new
    return [x if x[max(range(d), key=lambda i: abs(x[i]))] > 0 else -x for x in span]


class Whitening:
    """What :func:`fit` learned: ``n`` vectors of length ``d`` with sums ``s`` (without the shift), and for each component
    its unit vector, eigenvalue of the covariance and share of the trace."""

    def __init__(self, n: int, d: int, s: list[int], vectors: np.ndarray, values: list[float], explained: list[float]):
        self.n, self.d, self.s = n, d, s
        self.vectors, self.values, self.explained = vectors, values, explained


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Learn the whitening of all usable vectors.

    Null and empty vectors and those with null or non-finite entries are left out, and, where lengths differ, all but
    the most frequent length (ties: the longest).  Only components with a positive eigenvalue exist, so there may be
    fewer than asked for; without any vector there is none.  Equal eigenvalues share a space, of which some
    orthonormal basis is taken."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vector).cast("array<double>").alias("vector")).filter(usable("vector"))
    top = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if top is None:
        return Whitening(0, 0, [], np.zeros((0, 0)), [], [])
    d = top["d"]
    n, s, matrix = scatter(rows.filter(F.size("vector") == d), d)
    trace = int(sum(matrix[i, i] for i in range(d)))
    found: list[tuple[int, np.ndarray]] = []
    if trace:
        poly = characteristic_polynomial(spark, matrix)
        for root, times in largest_roots(poly, trace, components):
            found += [(root, v) for v in null_space(matrix, root, times)]
    found = found[:components]
    unit_vectors = np.array([[x / (1 << POINT) for x in v] for _, v in found]).reshape(-1, d)
    return Whitening(n, d, s, unit_vectors, [r / (n * n << ROOT) for r, _ in found],
                     [r / (trace << ROOT) for r, _ in found])


def transform(vectors: DataFrame, model: Whitening, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector of the model's length: vec_id, deviation (text of the exact sum over dimensions of
    (n * x - S)**2), whitened (array of doubles, one per component).  Null ids and repeated rows stay; other columns are
    not read; a model without components gives no rows."""
    kind = vectors.schema[vec_id].dataType.simpleString()
    rows = vectors.select(F.col(vec_id).cast("string").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.filter(usable("vector") & (F.size("vector") == model.d) & F.lit(len(model.values) > 0))
    n, d, sums = model.n, model.d, np.array(model.s, object)
    to_unit = model.vectors.T / np.sqrt(np.array(model.values))[None, :] if model.values else None

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                y = as_integers(part.column("vector"), d)
                reach = n * int(np.abs(y).max()) + max(abs(x) for x in model.s)
                small = d * reach * reach < 1 << 63
                far = y * n - sums.astype(np.int64) if small else y.astype(object) * n - sums
                white = (far.astype(np.float64) / n) @ to_unit
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array([str(x) for x in (far * far).sum(axis=1)], pa.string()),
                     pa.array(list(white), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    out = rows.mapInArrow(run, "vec_id string, deviation string, whitened array<double>")
    return out.withColumn("vec_id", F.col("vec_id").cast(kind))


def identity_error(whitened: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity (0 without components)."""
    cells = [F.abs(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) - float(i == j))
             for i in range(components) for j in range(i, components)]
    if not cells:
        return 0.0
    return float(max(whitened.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).first()))


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """Fit on all usable vectors and whiten them: one row per vector and component (from 1, by falling eigenvalue) with
    vec_id, component, n, deviation (text), whitened, explained, identity_error.  See :func:`fit` for what is left out."""
    model = fit(vectors, vector, components)
    rows = save(transform(vectors, model, vec_id, vector), "whitened")
    error = identity_error(rows, len(model.values))
    explained = F.array(*[F.lit(x) for x in model.explained]).cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
