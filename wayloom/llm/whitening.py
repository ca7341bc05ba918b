"""Whitening of embeddings from an exact characteristic polynomial.

Components become whole numbers, so n, the sums S and the scatter matrix M = n * sum(x x') - S S' (n squared times the
covariance) are exact integers, added up by Spark. The characteristic polynomial of M is found modulo many primes, dealt out
over tasks, by reduction to Hessenberg form, and put together by the Chinese remainder theorem. All its roots are real, so
sign changes after a shift count the roots beyond any point exactly; bisection parts and narrows them as far as their
distances ask. Null-space inverse iteration in fixed-point numbers of as many bits gives the components.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import keep

#: Bits by which a root's interval is narrowed at a time; half as many must lie between it and the next root's.
SPARE_BITS = 96


# ---- characteristic polynomial ----

def primes_below(top: int, n: int) -> list[int]:
    """The ``n`` largest primes below ``top`` (at most 2^31)."""
    def prime(p: int) -> bool:  # these bases decide every number below 3,215,031,751
        d, s = p - 1, 0
        while d % 2 == 0:
            d, s = d // 2, s + 1
        for a in (2, 3, 5, 7):
            x = pow(a, d, p)
            if x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(s - 1)):
                return False
        return True

    out, p = [], top - 1 | 1
    while len(out) < n:
        p -= 2
        if prime(p):
            out.append(p)
    return out


def polynomial_modulo(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(xI - matrix) modulo ``p``, lowest first."""
    d = len(matrix)
    h = np.array([[v % p for v in row] for row in matrix], np.int64).reshape(d, d)
    for k in range(d - 2):  # similar matrix with zeros below the subdiagonal
        rows = np.flatnonzero(h[k + 1:, k])
        if not len(rows):
            continue
        pivot = k + 1 + int(rows[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        u = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * u % p).sum(1)) % p
    poly = [np.zeros(d + 1, np.int64) for _ in range(d + 1)]
    poly[0][0] = 1
    for k in range(d):  # of the leading k+1 rows and columns
        now = np.roll(poly[k], 1) - h[k, k] * poly[k] % p
        along = 1
        for i in range(k - 1, -1, -1):
            along = along * int(h[i + 1, i]) % p
            if not along:
                break
            now = (now - poly[i] * (int(h[i, k]) * along % p) % p) % p
        poly[k + 1] = now % p
    return poly[d].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(xI - matrix) of a positive semidefinite integer matrix, lowest first; a prime to a row of work."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # the k-th elementary symmetric sum of non-negative roots is at most C(d, k) * (trace / d)^k
    most = max(math.comb(d, k) * trace ** k // max(1, d) ** k + 1 for k in range(d + 1))
    primes = primes_below(1 << 31, 2 * most.bit_length() // 61 + 3)
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches):
        for b in batches:
            ps = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array([polynomial_modulo(shared.value, p) for p in ps], pa.list_(pa.int64()))], ["p", "c"])

    tasks = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(tasks).mapInArrow(run, "p bigint, c array<bigint>").collect()
    rows = sorted(rows, key=lambda r: r.p)
    *used, check = rows
    product = math.prod(r.p for r in used)
    parts = [(q := product // r.p) * pow(q, -1, r.p) for r in used]
    out = []
    for k in range(d + 1):
        v = sum(part * r.c[k] for part, r in zip(parts, used)) % product
        out.append(v - product if 2 * v > product else v)
    if any((v - c) % check.p for v, c in zip(out, check.c)):
        raise ArithmeticError("the primes do not cover the coefficients")
    return out


# ---- real roots ----

def shifted(poly: list[int], by: int) -> list[int]:
    """The polynomial of x + by."""
    out = list(poly)
    for low in range(len(out) - 1):
        for k in range(len(out) - 2, low - 1, -1):
            out[k] += by * out[k + 1]
    return out


def scaled(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2^bits times as large."""
    return [c << bits * (len(poly) - 1 - k) for k, c in enumerate(poly)]


def roots_above(poly: list[int], at: int, bits: int) -> int:
    """How many roots (all real, counted as often as they occur) are larger than at / 2^bits: the sign changes of the
    polynomial shifted there, which is exact for real roots."""
    signs = [c > 0 for c in shifted(scaled(poly, bits), at) if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def common_factor(a: list[int], b: list[int], modulus: int | None = None) -> list[int]:
    """The greatest common divisor of two polynomials: modulo a prime, or over the whole numbers without content."""
    def trimmed(x):
        while x and not x[-1]:
            x.pop()
        if modulus is None and x:
            g = math.gcd(*x)
            x = [c // g for c in x]
        return x

    a, b = trimmed([c % modulus if modulus else c for c in a]), trimmed([c % modulus if modulus else c for c in b])
    while b:
        inverse = pow(b[-1], -1, modulus) if modulus else None
        while len(a) >= len(b):
            shift, top = len(a) - len(b), a[-1]
            if modulus:
                f = top * inverse % modulus
                for k, c in enumerate(b):
                    a[shift + k] = (a[shift + k] - f * c) % modulus
            else:
                a = [c * b[-1] for c in a]
                for k, c in enumerate(b):
                    a[shift + k] -= top * c
            a = trimmed(a) if len(a) else a
        a, b = b, a
    return a


@dataclass
class Root:
    """A root between low / 2^bits (excluded) and (low + 1) / 2^bits (included), and how often it occurs."""

    low: int
    bits: int
    times: int

    def value(self) -> Fraction:
        return Fraction(2 * self.low + 1, 2 << self.bits)


def largest_roots(poly: list[int], wanted: int) -> list[Root]:
    """The largest roots (``wanted`` of them, counted as often as they occur, or a few more) of a polynomial all of whose
    roots are positive, each alone in its interval, which is narrow next to its distance from the others."""
    slope = [k * c for k, c in enumerate(poly)][1:]
    single = any(len(common_factor(poly, slope, p)) == 1 for p in ((1 << 61) - 1, (1 << 89) - 1))
    double = [1] if single else common_factor(poly, slope)  # its roots are those that occur more than once, once less

    def distinct(low: int, bits: int, times: int) -> int:
        return times - (roots_above(double, low, bits) - roots_above(double, low + 1, bits) if len(double) > 1 else 0)

    top = max(1, abs(poly[-2] // poly[-1]) + 1).bit_length()  # the sum of the roots
    width = -top  # intervals of 2^top
    stack, found, got = [(0, width, roots_above(poly, 0, 0))], [], 0
    while stack and got < wanted + 1:  # one more, to know the distance of the last
        low, bits, times = stack.pop()
        if distinct_at(distinct, low, bits, times) == 1:
            found.append(Root(low, bits, times))
            got += times
            continue
        upper = above(poly, 2 * low + 1, bits + 1) - above(poly, 2 * low + 2, bits + 1)
        if times - upper:
            stack.append((2 * low, bits + 1, times - upper))
        if upper:
            stack.append((2 * low + 1, bits + 1, upper))
    out = [narrowed(poly, r, max(0, r.bits)) for r in found]
    for k in range(len(out) - 1):
        while distance(out[k], out[k + 1]) * (1 << min(out[k].bits, out[k + 1].bits)) < 1 << (SPARE_BITS // 2):
            out[k], out[k + 1] = (narrowed(poly, r, r.bits) for r in out[k:k + 2])
    return out


def above(poly: list[int], at: int, bits: int) -> int:
    """``roots_above`` for intervals of any width."""
    return roots_above(poly, at, bits) if bits >= 0 else roots_above(poly, at << -bits, 0)


def distinct_at(distinct, low: int, bits: int, times: int) -> int:
    if times == 1:
        return 1
    if bits >= 0:
        return distinct(low, bits, times)
    return 2  # wide intervals are parted first


def distance(a: Root, b: Root) -> Fraction:
    """At least so far apart are a larger and a smaller root."""
    return Fraction(a.low, 1 << a.bits) - Fraction(b.low + 1, 1 << b.bits)


def narrowed(poly: list[int], root: Root, bits: int) -> Root:
    """``root`` in an interval of 2^-(bits + SPARE_BITS)."""
    to = bits + SPARE_BITS
    low, high = root.low << to - root.bits, root.low + 1 << to - root.bits  # in steps of 2^-to
    exact = scaled(poly, to)

    def value(x: int) -> int:
        out = 0
        for c in reversed(exact):
            out = out * x + c
        return out

    odd = root.times % 2
    if odd:
        at_top = value(high)
        if not at_top:
            return Root(high - 1, to, root.times)
    else:
        beyond = roots_above(poly, high, to)
    while high - low > 1:
        mid = (low + high) // 2
        if odd:
            v = value(mid)
            low, high = (low, mid) if not v or (v > 0) == (at_top > 0) else (mid, high)
        else:
            low, high = (mid, high) if roots_above(poly, mid, to) > beyond else (low, mid)
    return Root(low, to, root.times)


# ---- components ----

def null_vectors(matrix: list[list[int]], root: Root) -> list[np.ndarray]:
    """Orthonormal vectors (as many as the root occurs) that matrix - root takes to almost nothing, by inverse iteration in
    fixed-point numbers."""
    d = len(matrix)
    at = root.value()
    size = max(1, max(abs(v) for row in matrix for v in row)).bit_length()
    bits = 2 * (root.bits + size) + SPARE_BITS
    one = 1 << bits
    # the matrix divided by 2^size, as fixed-point numbers
    a = np.array([[(v << bits) >> size for v in row] for row in matrix], object).reshape(d, d)
    off = (at.numerator << bits) // (at.denominator << size)
    for i in range(d):
        a[i, i] -= off
    order = list(range(d))
    for k in range(d):  # triangular factors with the largest pivots
        pivot = max(range(k, d), key=lambda i: abs(a[i, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
        if not a[k, k]:
            a[k, k] = 1
        if k + 1 < d:
            a[k + 1:, k] = (a[k + 1:, k] * one) // a[k, k]
            a[k + 1:, k + 1:] -= (a[k + 1:, k, None] * a[k, k + 1:]) >> bits

    def unit(x: np.ndarray) -> np.ndarray:
        top = max(1, max(abs(v) for v in x)).bit_length()
        x = x << max(0, bits - top) if top <= bits else x >> (top - bits)
        return (x * one) // math.isqrt(int((x * x).sum()))

    def solve(w: np.ndarray) -> np.ndarray:
        x = w[order].copy()
        for k in range(1, d):
            x[k] -= int((a[k, :k] * x[:k]).sum()) >> bits
        for k in range(d - 1, -1, -1):
            x[k] = ((x[k] - (int((a[k, k + 1:] * x[k + 1:]).sum()) >> bits)) << bits) // a[k, k]
        return unit(x)

    out: list[np.ndarray] = []
    for t in range(root.times):
        x = unit(np.array([((t * d + i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) - (1 << 63) for i in range(d)], object))
        for _ in range(3):
            x = solve(x)
            for v in out:
                x = x - ((v * int((v * x).sum() >> bits)) >> bits)
            x = unit(x)
        out.append(x)
    return [np.array([float(Fraction(int(v), one)) for v in x]) for x in out]


# ---- Spark ----

@dataclass
class Whitening:
    """Integer sums of the fitted vectors, and the components that hold their covariance."""

    dims: int
    n: int
    sums: list[int]  # of floor(scale * component)
    trace: int  # of n^2 times the covariance
    roots: list[float]  # eigenvalues of n^2 times the covariance, falling
    explained: list[float]
    components: np.ndarray  # a row for each root


def whole_numbers(vectors: DataFrame, vec_col: str, scale: int) -> DataFrame:
    """All columns of ``vectors`` as a struct ``row``, and ``x``, floor(scale * component), of the vectors that take part."""
    fit = vectors.filter((F.size(vec_col) > 0) & F.forall(
        vec_col, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))))
    return fit.select(F.struct(*vectors.columns).alias("row"), F.transform(F.col(vec_col), lambda v: F.floor(v.cast("double") * scale)).alias("x"))


def _matrix(b: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _products(x: np.ndarray) -> np.ndarray:
    """x'x, exactly: in floating point for as many rows at a time as cannot be rounded, else in Python's integers."""
    top = int(np.abs(x).max(initial=0))
    step = (1 << 53) // max(1, top * top)
    if not step:
        return x.T.astype(object) @ x.astype(object)
    out = np.zeros((x.shape[1],) * 2, object)
    for lo in range(0, len(x), step):
        part = x[lo:lo + step].astype(np.float64)
        out += (part.T @ part).astype(np.int64)
    return out


def fit_whitening(numbers: DataFrame, most: int) -> Whitening | None:
    """The largest components of distinct vectors in a column ``x`` of whole numbers; None without vectors or spread."""
    spark = numbers.sparkSession
    first = numbers.select(F.size("x")).first()
    if first is None:
        return None
    dims = first[0]

    def partial(batches):
        n, s, g = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for b in batches:
            x = _matrix(b, "x", dims)
            n, s, g = n + len(x), s + x.sum(0).astype(object) if len(x) else s, g + _products(x)
        if n:
            i, j = np.triu_indices(dims)
            keys = [(-1, -1), *((-1, k) for k in range(dims)), *zip(i.tolist(), j.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                                              pa.array([str(v) for v in [n, *s, *g[i, j]]])], ["i", "j", "v"])

    sums = numbers.select("x").mapInArrow(partial, "i int, j int, v string").groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    got = {(r.i, r.j): int(r.v) for r in sums.collect()}  # as many as a matrix of the dimensions holds
    n, s = got[-1, -1], [got[-1, k] for k in range(dims)]
    scatter = [[n * got[min(i, j), max(i, j)] - s[i] * s[j] for j in range(dims)] for i in range(dims)]
    trace = sum(scatter[i][i] for i in range(dims))
    if not trace:
        return None
    poly = characteristic_polynomial(spark, scatter)
    rank = next(dims - k for k, c in enumerate(poly) if c)
    roots = largest_roots(poly[dims - rank:], min(most, rank))
    values, components = [], []
    for r in roots:
        if len(components) < most:
            vectors = null_vectors(scatter, r)
            values += [r.value()] * len(vectors)
            components += vectors
    return Whitening(dims, n, s, trace, [float(v) for v in values[:most]], [float(v / trace) for v in values[:most]], np.array(components[:most]))


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - S, exactly."""
    n, s = model.n, np.array(model.sums, object)
    if n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62:
        return x * n - s.astype(np.int64)
    return x.astype(object) * n - s


def _whitened(z: np.ndarray, model: Whitening) -> np.ndarray:
    return z.astype(np.float64) @ (model.components / np.sqrt(model.roots)[:, None]).T


def _identity_error(numbers: DataFrame, model: Whitening) -> float:
    """The largest difference of the whitened vectors' covariance from the identity."""
    shared, k = numbers.sparkSession.sparkContext.broadcast(model), len(model.roots)

    def partial(batches):
        s, g = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = _whitened(_centred(_matrix(b, "x", shared.value.dims), shared.value), shared.value)
            s, g = s + w.sum(0), g + w.T @ w
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array([-1] * k + i.tolist(), pa.int32()), pa.array([*range(k), *j.tolist()], pa.int32()),
                                          pa.array([*s, *g[i, j]], pa.float64())], ["i", "j", "v"])

    sums = numbers.select("x").mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    got = {(r.i, r.j): r.v / model.n for r in sums.collect()}
    return max(abs(v - got[-1, i] * got[-1, j] - (i == j)) for (i, j), v in got.items() if i >= 0)


def whiten(vectors: DataFrame, most: int = 16, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each row and component (numbered from 1, at most ``most``): the id column, ``component``, ``n``, ``deviation``,
    ``whitened``, ``explained`` and ``identity_error``.

    Vectors become x = floor(scale * component). The covariance is that of the ``n`` distinct x, divisor n. ``deviation``
    is the exact sum of (n * x - S)^2 over the dimensions, S being the sums of the distinct x; ``whitened`` is x - S / n
    projected on a unit eigenvector and divided by the square root of its eigenvalue; ``explained`` is the eigenvalue's share
    of the trace; ``identity_error`` the largest difference of the distinct x's whitened covariance from the identity.

    Rows whose vector is null, empty, or holds null or non-finite components take no part, nor do those of another length
    than most rows. Ids may be null, repeated or of any type; repeated rows come out repeatedly, but are fitted on once. There
    are as many components as the covariance has rank, so an empty table, or one with a single distinct x, gives an empty
    result. A deviation beyond a long raises OverflowError; components of 2^62 / scale and more raise ValueError. Other
    columns do not matter.

    One shuffle, of the distinct vectors; of the rest, a matrix of the dimensions for each task.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType
    shape = f"id {kind.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    narrow = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    numbers = whole_numbers(narrow, "vec", scale)
    sizes = numbers.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n"), F.max(F.greatest(*[
        F.abs(f("row.vec").cast("double")) for f in (F.array_max, F.array_min)])).alias("top")).orderBy(F.desc("n"), "dims").first()
    if sizes is not None and sizes.top * scale >= 1 << 62:
        raise ValueError("components are too large")
    model = None
    if sizes is not None:
        numbers = numbers.filter(F.size("x") == sizes.dims).select("row.id", "x")
        distinct = keep(numbers.select("x").distinct(), "distinct")
        model = fit_whitening(distinct, most)
    if model is None:
        return spark.createDataFrame([], shape).withColumnRenamed("id", id_col)
    error = _identity_error(distinct, model)
    shared, k = spark.sparkContext.broadcast(model), len(model.roots)

    def run(batches):
        m = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                z = _centred(_matrix(part, "x", m.dims), m)
                top = int(np.abs(z).max(initial=0))
                exact = z if m.dims * top * top < 1 << 63 else z.astype(object)
                deviation = (exact * exact).sum(1)
                if int(deviation.max()) >= 1 << 63:
                    raise OverflowError("a deviation does not fit into a long")
                rows = len(z)
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                    pa.array(np.full(rows * k, m.n), pa.int64()), pa.array(np.repeat(deviation.astype(np.int64), k)), pa.array(_whitened(z, m).ravel()),
                    pa.array(np.tile(m.explained, rows)), pa.array(np.full(rows * k, error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return numbers.mapInArrow(run, shape).withColumnRenamed("id", id_col)
