"""Whitening of embeddings by the leading eigenvectors of their covariance."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.llm.shared import stage

SCALE = 256
COMPONENTS = 4
EPS = float(np.finfo(float).eps)
# Eigenvalues this close, as a share of the largest in size, count as one cluster.
CLUSTER = 1e-3
# Rounds of inverse iteration, of which two or three are enough as eigenvalues are known to the last bits.
ROUNDS = 6
SEED = 42


def tridiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and Householder vectors of a symmetric matrix.

    Reflection k, I - 2 v v', leaves the first k + 1 coordinates alone and clears what column k has
    below the off-diagonal; a column that is clear already has a zero vector.
    """
    a = np.array(matrix, float)
    d = len(a)
    vectors = []
    for k in range(d - 2):
        column = a[k + 1 :, k].copy()
        scale = np.abs(column[1:]).max()
        v = np.zeros(d)
        if scale:
            size = float(np.abs(column).max())
            column /= size
            column[0] += np.copysign(np.linalg.norm(column), column[0])
            v[k + 1 :] = column / np.linalg.norm(column)
            p = a @ v
            w = p - (v @ p) * v
            a -= 2 * (np.outer(v, w) + np.outer(w, v))
        vectors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), vectors


def below(diagonal: np.ndarray, off: np.ndarray, x: float, tiny: float) -> int:
    """How many eigenvalues of a tridiagonal matrix lie below x: the negative pivots of T - x."""
    count, pivot = 0, 1.0
    for i, value in enumerate(diagonal.tolist()):
        pivot = value - x - (off[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected by Sturm counts until no double lies between."""
    reach = np.abs(np.append(off, 0)) + np.abs(np.insert(off, 0, 0))
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    size = max(abs(low), abs(high))
    tiny = max(EPS * EPS * size, np.finfo(float).tiny)
    low, high = low - 4 * EPS * size - tiny, high + 4 * EPS * size + tiny
    values = []
    for place in range(1, k + 1):
        # The value number ``place`` from above is the first x with more than d - place values below it.
        a, b = low, values[-1] + 2 * EPS * size if values else high
        while b - a > tiny and a < (mid := a + (b - a) / 2) < b:
            if below(diagonal, off, mid, tiny) > len(diagonal) - place:
                b = mid
            else:
                a = mid
        values.append(b)
    return np.array(values)


def _solve(diagonal: np.ndarray, off: np.ndarray, x: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """Solve (T - x) y = right by elimination with row exchanges; a pivot of nothing becomes tiny."""
    d = len(diagonal)
    # Three bands of the upper factor.
    u0, u1, u2 = diagonal - x, np.append(off, 0.0), np.zeros(d)
    y = right.copy()
    for i in range(d - 1):
        under, main, upper = off[i], u0[i + 1], u1[i + 1]
        if abs(under) > abs(u0[i]):
            factor = u0[i] / under
            u0[i], u0[i + 1] = under, u1[i] - factor * main
            u1[i], u1[i + 1] = main, -factor * upper
            u2[i] = upper
            y[i], y[i + 1] = y[i + 1], y[i] - factor * y[i + 1]
        else:
            if abs(u0[i]) < tiny:
                u0[i] = tiny
            factor = under / u0[i]
            u0[i + 1] = main - factor * u1[i]
            y[i + 1] -= factor * y[i]
    for i in range(d - 1, -1, -1):
        if abs(u0[i]) < tiny:
            u0[i] = tiny
        above = (u1[i] * y[i + 1] if i + 1 < d else 0.0) + (u2[i] * y[i + 2] if i + 2 < d else 0.0)
        y[i] = (y[i] - above) / u0[i]
    return y


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows.

    Each vector starts at random and goes through inverse iteration on the tridiagonal form; within a
    cluster of close eigenvalues it is made orthogonal to those before it in every round. The
    reflections then turn the vectors back.
    """
    diagonal, off, reflections = tridiagonalise(matrix)
    d = len(diagonal)
    values = leading_values(diagonal, off, k)
    size = max(float(np.abs(diagonal).max()), float(np.abs(off).max()) if d > 1 else 0.0)
    tiny = max(EPS * size, np.finfo(float).tiny)
    start = np.random.default_rng(SEED)
    vectors: list[np.ndarray] = []
    cluster = 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > CLUSTER * size:
            cluster = i
        y = start.standard_normal(d)
        for _ in range(ROUNDS):
            y = _solve(diagonal, off, value, y / np.abs(y).max(), tiny)
            y /= np.abs(y).max()
            # Twice, as once leaves what cancellation has made.
            for _ in range(2):
                for other in vectors[cluster:]:
                    y -= (other @ y) * other
            y /= np.linalg.norm(y)
        vectors.append(y)
    found = np.array(vectors).reshape(k, d)
    for v in reversed(reflections):
        found -= 2 * np.outer(found @ v, v)
    return values, found / np.linalg.norm(found, axis=1, keepdims=True)


def _matrix(batch: pa.RecordBatch, at: int, width: int) -> np.ndarray:
    """A list column as rows of ``width`` numbers; what shorter lists lack is zero."""
    lists = batch.column(at)
    flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _summed(rows: DataFrame, work, kind: str) -> DataFrame:
    """Rows (i, j, v) of each task, added up over all of them."""
    return rows.mapInArrow(work, f"i int, j int, v {kind}").groupBy("i", "j").agg(F.sum("v").alias("v"))


def _covariance(fit: DataFrame, center: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The covariance of (x - center) @ turn over the rows of ``fit``, times their number."""
    width, k = turn.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            own = (_matrix(batch, 0, width) - center) @ turn
            total += own.T @ own
        i, j = np.triu_indices(k)
        columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "v"])

    out = np.zeros((k, k))
    for r in _summed(fit, work, "double").collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def usable(column: str) -> Column:
    """True if a vector isn't null and holds neither nulls nor anything infinite or not a number."""
    entry = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.col(column).isNotNull() & ~F.exists(column, entry)


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE
) -> DataFrame:
    """One row per usable row and component: key, component, n, deviation, whitened, explained, identity_error.

    Vectors are rounded down to multiples of 1 / ``scale`` and held as long integers x. The fit takes each
    distinct x once; tasks add up its sums and then, with the mean known, its centred products, and the
    driver gets d sums and d * (d + 1) / 2 products for d dimensions. Eigenvalues and vectors of that one
    small matrix are found there and sent with the projecting tasks. ``deviation`` is the sum over the
    dimensions of (n * x - S) ** 2, exact; ``whitened`` the projection of x - S / n over the root of the
    eigenvalue; ``explained`` the eigenvalue's share of the trace; ``identity_error`` the largest entry of
    the whitened fit list's covariance minus the identity.

    Rows whose vector is null or holds null, NaN or infinite entries are left out. Vectors shorter than
    the longest count as zero beyond their end. Equal eigenvalues get any orthonormal vectors of their
    space. A component without variance can't be whitened, so there are at most as many components as the
    covariance has rank; a table with fewer than two distinct vectors gives no rows, as an empty one does.
    Null and repeated keys are rows like others; other columns are ignored. A deviation that no long can
    hold is null. Entries must stay below 2 ** 53 / ``scale`` in size, beyond which doubles skip integers.
    """
    numbers = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double")).alias("x")
    rows = vectors.select(F.col(f"`{key}`").alias("key"), numbers).filter(usable("x"))
    rows = rows.withColumn("x", F.transform("x", lambda c: F.floor(c * scale).cast("long")))
    fit = stage(rows.select("x").distinct(), "fit")
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kind = rows.schema["key"].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
        "identity_error double"
    )
    n, width = fit.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if n < 2 or not width:
        return vectors.sparkSession.createDataFrame([], schema)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for batch in batches:
            found = _matrix(batch, 0, width)
            safe = len(found) == 0 or int(np.abs(found).max()) < (1 << 62) // len(found)
            total += (found if safe else found.astype(object)).sum(axis=0)
        columns = [pa.array(range(width), pa.int32()), pa.array([0] * width, pa.int32())]
        columns.append(pa.array([Decimal(int(t)) for t in total], pa.decimal128(28, 0)))
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "v"])

    total = [0] * width
    for r in _summed(fit, sums, "decimal(28,0)").collect():
        total[r.i] = int(r.v)
    mean = np.array([t / n for t in total])
    matrix = _covariance(fit, mean, np.eye(width)) / n
    trace = float(np.trace(matrix))
    values, found = leading_components(matrix, min(components, width))
    kept = values > width * EPS * trace
    values, found = values[kept], found[kept]
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    turn = (found / np.sqrt(values)[:, None]).T
    error = float(np.abs(_covariance(fit, mean, turn) / n - np.eye(len(values))).max())
    explained = values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, exact = len(explained), np.array(total, object)
        fits = max(map(abs, total)) < 1 << 62
        whole = exact.astype(np.int64) if fits else exact
        limit = 1 << 63
        for batch in batches:
            x = _matrix(batch, 1, width)
            if not len(x):
                continue
            # Whether n * x - S, and the sum of its squares, surely fit into a long.
            bound = n * int(np.abs(x).max()) + max(map(abs, total))
            if fits and width * bound * bound < limit:
                deviation = ((n * x - whole) ** 2).sum(axis=1).tolist()
            else:
                deviation = [d if d < limit else None for d in ((n * x.astype(object) - exact) ** 2).sum(axis=1)]
            whitened = (x - mean) @ turn
            rows = np.repeat(np.arange(len(x)), k)
            arrays = [
                batch.column(0).take(pa.array(rows)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(rows), n, np.int64)),
                pa.array(deviation, pa.int64()).take(pa.array(rows)),
                pa.array(whitened.reshape(-1)),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(rows), error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(project, schema)
