"""Whitening of embeddings by the exact characteristic polynomial of their scatter matrix (op13).

Entries are turned to integers, so the scatter matrix n * sum(x x') - S S' is one of integers, summed without rounding:
tasks multiply slices of 20 bits by floating point, whose sums stay below 2^53, and pass on limbs of 30 bits, which Spark
adds. Its characteristic polynomial is reduced to Hessenberg form modulo as many primes as a bound on the coefficients
needs, a task for some primes each, and put together by Chinese remainders. All roots of it are real, so the sign changes
of its coefficients, moved to a point, count the roots beyond that point exactly: bisection by them isolates the largest
roots, and by signs narrows each to PRECISION bits. Roots that can't be told apart by then share a component space. Inverse
iteration in fixed-point integers, a task for each space, gives the components. What comes to the driver (sums, residues,
roots, components) is bounded by the dimension, not by the rows.

Left out: rows whose vector is null or empty, holds null or non-finite entries or such as no long holds 1024 times (beyond
2^62), or has another length than most vectors (of equally frequent lengths the longest counts). Repeated rows and ids stay
rows of their own. Components stand only for positive eigenvalues: a table of one row or of equal rows has none, and so no
result rows, as an empty one. A deviation beyond a long is null. Other columns are passed over.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages

COMPONENTS = 8
SCALE = 1024
#: Rows that are multiplied at once: products of two slices of 20 bits, summed over so many, are exact in doubles.
ROWS, SLICE_BITS, LIMB = 4096, 20, 30
#: Bits of a root beyond its leading one, and of the shift that keeps inverse iteration regular.
PRECISION, SHIFT = 200, 120
_SUMS = "i int, j int, limb int, value long"


def integers(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, y: 1024 times each entry, rounded down, of the rows that take part; their lengths may differ."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(SCALE * c) < float(1 << 62)), F.lit(False)))
    rows = df.filter(F.col(vector_col).isNotNull()).filter((F.size(v) > 0) & good)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(SCALE * c).cast("long")).alias("y"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    col = batch.column("y")
    return np.asarray(col.flatten()).astype(np.int64).reshape(len(col), -1)


def _slices(y: np.ndarray) -> list[np.ndarray]:
    """Doubles whose sum, each times 2^(20 k), is y; the last has the sign."""
    out, mask = [], (1 << SLICE_BITS) - 1
    while y.size and max(int(y.max()), -int(y.min())) > mask:
        out.append((y & mask).astype(np.float64))
        y = y >> SLICE_BITS
    return [*out, y.astype(np.float64)]


def _add_scatter(batches):
    """Limbs of the sums of products (i <= j), of entries (i = -1) and of rows (i = j = -1) of a partition."""
    products = sums = None
    rows = 0
    for batch in (b for b in batches if b.num_rows):
        whole = _matrix(batch)
        for a in range(0, len(whole), ROWS):
            y = whole[a : a + ROWS]
            if products is None:
                products, sums = np.zeros((y.shape[1],) * 2, object), np.zeros(y.shape[1], object)
            parts = _slices(y)
            for p, left in enumerate(parts):
                sums += left.sum(axis=0).astype(np.int64).astype(object) << (SLICE_BITS * p)
                for q, right in enumerate(parts):
                    products += (left.T @ right).astype(np.int64).astype(object) << (SLICE_BITS * (p + q))
            rows += len(y)
    if not rows:
        return
    d = len(sums)
    cells = [(-1, -1, rows), *((-1, j, int(sums[j])) for j in range(d)), *((i, j, int(products[i, j])) for i in range(d) for j in range(i, d))]
    out = []
    for i, j, value in cells:
        sign, rest, k = (1 if value >= 0 else -1), abs(value), 0
        while rest:
            if rest & ((1 << LIMB) - 1):
                out.append((i, j, k, sign * (rest & ((1 << LIMB) - 1))))
            rest, k = rest >> LIMB, k + 1
    for a in range(0, len(out), 50_000):
        cols = list(zip(*out[a : a + 50_000], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["i", "j", "limb", "value"])


def scatter(rows: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums of entries, n * sum(y y') - S S') of rows (y) of d entries, exact."""
    limbs = rows.select("y").mapInArrow(_add_scatter, _SUMS).groupBy("i", "j", "limb").agg(F.sum("value").alias("value")).collect()
    n, sums, g = 0, [0] * d, [[0] * d for _ in range(d)]
    for i, j, k, value in limbs:
        value <<= LIMB * k
        if j < 0:
            n += value
        elif i < 0:
            sums[j] += value
        else:
            g[i][j] += value
    for i in range(d):
        for j in range(i, d):
            g[i][j] = g[j][i] = n * g[i][j] - sums[i] * sums[j]
    return n, sums, g


def primes(count: int) -> list[int]:
    """The greatest primes below 2^31, by a sieve of ranges from the top."""
    out, top, width = [], 1 << 31, 1 << 16
    small = [p for p in range(2, 46_342) if all(p % q for q in range(2, math.isqrt(p) + 1))]
    while len(out) < count:
        at = np.ones(width, bool)
        for p in small:
            at[-(top - width) % p :: p] = False
        out += [int(top - width + i) for i in np.flatnonzero(at)[::-1]]
        top -= width
    return out[:count]


def modular_polynomial(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, highest first, of the characteristic polynomial modulo p < 2^31, by reduction to Hessenberg form."""
    h, d = matrix.astype(np.int64) % p, len(matrix)
    for k in range(d - 2):
        pivots = np.flatnonzero(h[k + 1 :, k])
        if not len(pivots):
            continue
        r = k + 1 + int(pivots[0])
        if r != k + 1:
            h[[k + 1, r]] = h[[r, k + 1]]
            h[:, [k + 1, r]] = h[:, [r, k + 1]]
        m = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - m[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * m % p).sum(axis=1)) % p
    # Polynomials of the leading blocks, lowest coefficient first.
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        weights, chain = np.zeros(k + 1, np.int64), 1
        weights[k] = h[k, k]
        for i in range(k - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            weights[i] = int(h[i, k]) * chain % p
        new = np.roll(polys[k], 1)
        polys[k + 1] = (new - (polys[: k + 1] * weights[:, None] % p).sum(axis=0)) % p
    return polys[d][::-1]


def _coefficient_bits(trace: int, d: int) -> int:
    """No coefficient of a polynomial with d roots of at least 0 and this sum is longer (Maclaurin), with a sign and a spare bit."""
    mean = max(trace.bit_length() - math.log2(d), 0)
    return 2 + math.ceil(max(math.log2(math.comb(d, k)) + k * mean for k in range(d + 1)))


def polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients, highest first, of the characteristic polynomial of a positive semidefinite matrix of integers."""
    d = len(matrix)
    chosen = primes(_coefficient_bits(sum(matrix[i][i] for i in range(d)), d) // 30 + 1)
    shared = spark.sparkContext.broadcast(matrix)

    def reduce_(batches):
        whole = np.array(shared.value, dtype=object)
        for batch in batches:
            own = batch.column("prime").to_pylist()
            rest = [modular_polynomial((whole % p).astype(np.int64), p).tolist() for p in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(rest, pa.list_(pa.int64()))], names=["prime", "rest"])

    parts = min(len(chosen), max(spark.sparkContext.defaultParallelism, len(chosen) // 16))
    frame = spark.createDataFrame([(p,) for p in chosen], "prime long").repartition(parts)
    rests = {r.prime: r.rest for r in frame.mapInArrow(reduce_, "prime long, rest array<long>").collect()}
    shared.destroy()
    product = math.prod(chosen)
    out = [0] * (d + 1)
    for p in chosen:
        other = product // p
        unit = other * pow(other % p, -1, p)
        for k, r in enumerate(rests[p]):
            out[k] += unit * r
    return [c - product if 2 * c > product else c for c in (x % product for x in out)]


def _moved(poly: list[int], a: int) -> list[int]:
    """Coefficients of poly(x + a)."""
    c = list(poly)
    for end in range(len(c), 1, -1):
        for j in range(1, end):
            c[j] += a * c[j - 1]
    return c


def roots_above(poly: list[int], a: int) -> int:
    """How many roots, by multiplicity, of a polynomial with real roots only are greater than a: its sign changes there."""
    signs = [c > 0 for c in _moved(poly, a) if c]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _value(poly: list[int], x: int) -> int:
    out = 0
    for c in poly:
        out = out * x + c
    return out


def largest_roots(poly: list[int], count: int) -> list[tuple[int, int, int]]:
    """(root times 2^s, s, multiplicity) of the positive roots, falling, until `count` roots are covered.

    The roots must be real and not negative. A multiplicity above 1 also stands for roots that agree in PRECISION bits.
    """
    degree = len(poly) - 1
    positive = degree - next(i for i, c in enumerate(reversed(poly)) if c)
    count, out, bound = min(count, positive), [], -poly[1] if degree else 0
    s = max(0, PRECISION + 60 - bound.bit_length())
    while True:
        scaled = [c << (s * k) for k, c in enumerate(poly)]
        out, todo = [], [(0, bound << s, positive, 0)]  # (low, high], roots above low, roots above high
        fine = True
        while todo and sum(m for *_, m in out) < count:
            low, high, above, beyond = todo.pop()
            m = above - beyond
            if m and (m == 1 or high - low <= max(1, low >> PRECISION)):
                if m == 1:
                    low, high = _narrowed(scaled, low, high)
                fine &= low.bit_length() > PRECISION or (high == low)
                out.append((high, s, m))
            elif m:
                middle = (low + high) // 2
                here = roots_above(scaled, middle)
                todo += [(low, middle, above, here), (middle, high, here, beyond)]
        if fine:
            return out
        s += 2 * PRECISION  # a root so small needs more places


def _narrowed(poly: list[int], low: int, high: int) -> tuple[int, int]:
    """The interval (low, high] of one simple root, bisected by signs."""
    if not _value(poly, high):
        return high, high
    sign = _value(poly, high) > 0
    while high - low > max(1, low >> PRECISION):
        middle = (low + high) // 2
        value = _value(poly, middle)
        if not value:
            return middle, middle
        low, high = (low, middle) if (value > 0) == sign else (middle, high)
    return low, high


def null_vectors(matrix: list[list[int]], root: int, s: int, m: int) -> list[list[float]]:
    """m orthonormal vectors that matrix - root / 2^s takes to zero, by inverse iteration in integers."""
    d = len(matrix)
    a = np.array([[x << s for x in row] for row in matrix], dtype=object)
    at = np.arange(d)
    a[at, at] -= root + max(1, root >> SHIFT)
    places = int(np.abs(a).max()).bit_length() + 64
    order, steps = list(range(d)), []
    for k in range(d):
        r = k + int(np.argmax(np.abs(a[k:, k])))
        if r != k:
            a[[k, r]] = a[[r, k]]
            order[k], order[r] = order[r], order[k]
        pivot = a[k, k] = a[k, k] or 1
        steps.append((a[k + 1 :, k] << places) // pivot)
        if k + 1 < d:
            a[k + 1 :, k + 1 :] -= (steps[k][:, None] * a[k, k + 1 :]) >> places
    random = np.random.default_rng(7)
    vectors = [np.array([int(x) << places for x in random.integers(1, 1 << 20, d)], dtype=object) for _ in range(m)]
    for _ in range(3):
        solved = []
        for v in vectors:
            b = v[order].copy()
            for k in range(d - 1):
                b[k + 1 :] -= (steps[k] * b[k]) >> places
            x = np.zeros(d, object)
            for k in range(d - 1, -1, -1):
                x[k] = ((b[k] - (int((a[k, k + 1 :] * x[k + 1 :]).sum()) >> places if k + 1 < d else 0)) << places) // a[k, k]
            solved.append(x)
        vectors = _orthonormal(solved, places)
    return [[_double(int(x), 1 << places) for x in v] for v in vectors]


def _orthonormal(vectors: list[np.ndarray], places: int) -> list[np.ndarray]:
    """Vectors of length 2^places, each orthogonal to those before it."""
    out = []
    for v in vectors:
        for _ in range(2):
            for u in out:
                v = v - ((u * (int((u * v).sum()) >> places)) >> places)
            size = math.isqrt(int((v * v).sum()))
            v = (v << places) // max(size, 1)
        out.append(v)
    return out


def _double(x: int, y: int) -> float:
    """x / y, rounded once."""
    return x / y


def components(spark: SparkSession, matrix: list[list[int]], count: int = COMPONENTS) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(eigenvalues of the matrix as (times 2^s, s), falling; unit eigenvectors in rows) of its greatest positive eigenvalues, at most count."""
    if not matrix or not sum(matrix[i][i] for i in range(len(matrix))):
        return [], np.zeros((0, len(matrix)))
    found = largest_roots(polynomial(spark, matrix), count)
    shared = spark.sparkContext.broadcast(matrix)

    def solve(batches):
        for batch in batches:
            for r in batch.to_pylist():
                vectors = null_vectors(shared.value, int(r["root"]), r["s"], r["m"])
                yield pa.RecordBatch.from_arrays([pa.array([r["k"]], pa.int32()), pa.array([vectors], pa.list_(pa.list_(pa.float64())))], names=["k", "vectors"])

    frame = spark.createDataFrame([(k, str(root), s, m) for k, (root, s, m) in enumerate(found)], "k int, root string, s int, m int").repartition(len(found))
    solved = {r.k: r.vectors for r in frame.mapInArrow(solve, "k int, vectors array<array<double>>").collect()}
    shared.destroy()
    values = [(root, s) for root, s, m in found for _ in range(m)]
    return values[:count], np.array([v for k in range(len(found)) for v in solved[k]])[:count]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """A row for each remaining vector and component: n, deviation (sum of (n * x - S)^2), the whitened value, the share of the variance, and the error of the whitening as a whole.

    x is floor(1024 * entry) + 100000; the constant cancels in all of these.
    """
    spark, stages = df.sparkSession, Stages()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = stages.stage(integers(df, id_col, vector_col))
    most = rows.groupBy(F.size("y").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = most[0].d if most else 0
    rows = rows.filter(F.size("y") == d)
    n, sums, matrix = scatter(rows, d) if d else (0, [], [])
    values, vectors = components(spark, matrix, count)
    if not values:
        stages.drop()
        return spark.createDataFrame([], schema)
    trace = sum(matrix[i][i] for i in range(d))
    # Deviations of whitened values: e is value / (2^s n^2), so the root of it is sqrt(value / 2^s) / n.
    weights = vectors.T / np.array([math.sqrt(_double(v, 1 << s)) / n for v, s in values])
    explained = [_double(v, trace << s) for v, s in values]
    floors, rest = np.array([x // n for x in sums], dtype=np.int64), np.array([x % n for x in sums], dtype=object)
    shares = np.array([_double(int(r), n) for r in rest])

    def project(batches):
        for batch in (b for b in batches if b.num_rows):
            y = _matrix(batch) - floors
            most = max(int(y.max()), -int(y.min())) + 1
            if d * (n * most) ** 2 < 1 << 63:
                own = ((n * y - rest.astype(np.int64)) ** 2).sum(axis=1)
                deviation = pa.array(own, pa.int64())
            else:
                exact = ((y.astype(object) * n - rest) ** 2).sum(axis=1)
                deviation = pa.array([x if x < 1 << 63 else None for x in exact], pa.int64())
            w = (y - shares) @ weights
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, lists], names=["vec_id", "deviation", "w"])

    done = stages.stage(rows.mapInArrow(project, "vec_id long, deviation long, w array<double>"))
    k = len(values)
    means = done.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(k)]).first()
    centred = [F.col("w")[i] - F.lit(means[i]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    covariance = done.agg(*[(F.sum(centred[i] * centred[j]) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(covariance, pairs, strict=True))
    out = done.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(F.array(*[F.lit(x) for x in explained]), F.col("k") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
