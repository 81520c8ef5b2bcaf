"""Whitening of embeddings by their principal components.

Entries become integers, ``floor(64 * c) + 1000000``, and each distinct vector
counts once. Sums are exact. The covariance is a sum of outer products of centred
vectors, kept in double-double: products and sums keep their rounding errors by
error-free transformations, each task hands on a high and a low part, and these
are merged in steps of bounded width. The eigen-solve is LAPACK's divide and
conquer on the tridiagonal form (``syevd``, behind ``numpy.linalg.eigh``), of a
matrix whose size is the dimension, whatever the number of rows.

Nulls: a vector that is null, or holds null, NaN or infinite entries, is dropped; a
null id is kept. Repeated rows give rows each and count once in the fit. A
vector of another length than the most frequent (of equally frequent ones, the
longest) has no covariance with the rest and is dropped, as is one with an entry of
2 ** 46 or more in size, beyond which the integers are not exact. A component whose
variance is zero to working precision cannot be whitened and is left out, so a
table with one distinct vector, like an empty one, gives no rows. Of equal
eigenvalues any basis may be taken, the same for all rows. A deviation
beyond a long is null. Columns other than those named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

#: Partial matrices are merged so many at a time.
WIDTH = 64
#: Entries of a chunk of centred vectors that is multiplied at once.
CHUNK = 1 << 15


def two_sum(a, b):
    """``a + b`` and its rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _halves(a):
    c = 134217729.0 * a  # 2 ** 27 + 1
    high = c - (c - a)
    return high, a - high


def two_product(a, b):
    """``a * b`` and its rounding error."""
    p = a * b
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def dd_add(a, b):
    """Sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    e = e + (a[1] + b[1])
    high = s + e
    return high, e - (high - s)


def outer_sum(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper triangle of the sum of outer products of the rows ``high + low``, as a double-double."""
    d = high.shape[1]
    out = np.zeros((d, d)), np.zeros((d, d))
    for i in range(d):
        p, e = two_product(high[:, i : i + 1], high[:, i:])
        e += high[:, i : i + 1] * low[:, i:] + low[:, i : i + 1] * high[:, i:]
        while len(p) > 1:  # pairs of rows, again and again
            half = len(p) // 2
            q = dd_add((p[:half], e[:half]), (p[half : 2 * half], e[half : 2 * half]))
            p, e = (np.concatenate([x, y[2 * half :]]) for x, y in zip(q, (p, e), strict=True))
        out[0][i, i:], out[1][i, i:] = p[0], e[0]
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``n * x - sums`` exactly, and that over ``n`` as a double-double."""
    middle = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    near = x - np.asarray(middle, "i8")  # |x| < 2 ** 53
    exact = near * n - np.asarray(rest, "i8") if len(x) == 0 or int(np.abs(near).max()) < (2**62 - n) // n else near.astype(object) * n - np.asarray(rest, object)
    whole = exact // n
    part = (exact - whole * n).astype(float)
    f = part / n
    p, e = two_product(f, np.float64(n))
    high, low = two_sum(whole.astype(float), f)
    return exact, high, low + ((part - p) - e) / n


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def integer_vectors(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """``key, x`` of the vectors that can be used, and their length (0: there are none)."""
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= 2.0**46)
    rows = rows.where(F.col("v").isNotNull() & ~F.exists("v", odd) & (F.size("v") > 0))
    first = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = first.d if first else 0
    to_long = lambda c: F.floor(c * 64).cast("long") + 1_000_000
    return rows.where(F.size("v") == d).select("key", F.transform("v", to_long).alias("x")), d


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors, and the exact sum of each dimension."""

    def part(batches):
        n, high, low = 0, np.zeros(d, "i8"), np.zeros(d, "i8")
        for b in batches:
            x = _vectors(b.column(0), d)
            n, high, low = n + len(x), high + (x >> 26).sum(0), low + (x & (2**26 - 1)).sum(0)  # neither sum overflows
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([0, *high.tolist()], pa.int64()), pa.array([n, *low.tolist()], pa.int64())], ["i", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = fit.mapInArrow(part, "i int, high long, low long").groupBy("i").agg(exact("high"), exact("low")).collect()  # a row a dimension
    s = {r.i: (int(r.high) << 26) + int(r.low) for r in rows}
    return s.get(-1, 0), [s.get(i, 0) for i in range(d)]


def compensated_covariance(fit: DataFrame, n: int, d: int, rows_of) -> np.ndarray:
    """Sum of outer products of ``rows_of(batch)`` (high and low parts, ``d`` wide) over ``n``, as a full matrix."""

    def part(batches):
        total, step = (np.zeros((d, d)), np.zeros((d, d))), max(1, CHUNK // d)
        for b in batches:
            high, low = rows_of(b)
            for i in range(0, len(high), step):
                total = dd_add(total, outer_sum(high[i : i + step], low[i : i + step]))
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *(pa.array([m.tobytes()], pa.binary()) for m in total)], ["at", "high", "low"])

    def merged(table):
        table = table.sort_by("at")
        total = np.zeros(d * d), np.zeros(d * d)
        for pair in zip(table["high"].to_pylist(), table["low"].to_pylist(), strict=True):
            total = dd_add(total, tuple(np.frombuffer(x) for x in pair))
        return pa.table([pa.array([table["at"][0].as_py() // WIDTH], pa.int64()), *(pa.array([m.tobytes()], pa.binary()) for m in total)], ["at", "high", "low"])

    parts = materialise(fit.mapInArrow(part, "at long, high binary, low binary"), "outer")
    while parts.count() > WIDTH:
        parts = materialise(parts.groupBy(F.floor(F.col("at") / WIDTH).alias("g")).applyInArrow(lambda t: merged(t), "at long, high binary, low binary"), "outer")
    total = np.zeros((d, d)), np.zeros((d, d))
    for r in sorted(parts.collect(), key=lambda r: r["at"]):  # at most WIDTH matrices
        total = dd_add(total, tuple(np.frombuffer(x).reshape(d, d) for x in (r.high, r.low)))
    upper = (total[0] + total[1]) / n
    return np.triu(upper) + np.triu(upper, 1).T


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` of each usable row and component."""
    spark = df.sparkSession
    rows, d = integer_vectors(df, key, vector)
    out = f"`{key}` {dict(df.dtypes)[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not d:
        return spark.createDataFrame([], out)
    fit = materialise(rows.select("x").distinct(), "vectors")
    n, sums = _sums(fit, d)
    v = compensated_covariance(fit, n, d, lambda b: centred(_vectors(b.column(0), d), n, sums)[1:])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > d * np.finfo(float).eps * values[0]).sum())) if values[0] > 0 else 0
    if not k:
        return spark.createDataFrame([], out)
    axes, explained = vectors[:, :k] / np.sqrt(values[:k]), values[:k] / np.trace(v)

    def projected(b):
        y = centred(_vectors(b.column(0), d), n, sums)[1] @ axes
        return y, np.zeros_like(y)

    error = float(np.abs(compensated_covariance(fit, n, k, projected) - np.eye(k)).max())

    def put(batches):
        for b in batches:
            exact, high, _ = centred(_vectors(b.column(1), d), n, sums)
            small = exact.dtype != object and (len(exact) == 0 or float(np.abs(exact).max()) ** 2 * d < 2.0**62)
            squares = ((exact if small else exact.astype(object)) ** 2).sum(1).tolist()
            far = pa.array([s if s < 2**63 else None for s in squares], pa.int64())
            m, at = len(high), pa.array(np.repeat(np.arange(len(high)), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), m)), pa.array(np.full(m * k, n)), far.take(at), pa.array((high @ axes).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(put, out)
