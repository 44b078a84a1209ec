"""Whitening of embeddings by spectral divide and conquer.

The covariance is summed up by Spark; its size is that of one vector, squared. The QDWH iteration gives the
polar factor of the shifted covariance, whose sign splits the space into the invariant subspaces above and
below the shift; each is split again until it is one component (or a subspace of equal eigenvalues). The
components are then broadcast to the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
_EPS = np.finfo(float).eps


def polar_factor(a: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QR-based dynamically weighted Halley steps."""
    d = len(a)
    x = a / np.linalg.norm(a)
    low = 1e-3 * _EPS  # below every singular value but those that are zero in double precision
    for _ in range(rounds):
        s = low * low
        t = np.cbrt(4 * (1 - s) / (s * s)) if low < 1 else 0.0
        wa = np.sqrt(1 + t) + 0.5 * np.sqrt(8 - 4 * t + 8 * (2 - s) / (s * np.sqrt(1 + t)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(d)]))
        after = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:d] @ q[d:].T)
        after = (after + after.T) / 2
        step = np.linalg.norm(after - x)
        x, low = after, min(1.0, low * (wa + wb * s) / (1 + wc * s))
        if step < 10 * d * _EPS and 1 - low < 1e-8:
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces of `a` above and below a shift; None if no shift parts them."""
    d = len(a)
    mean = np.trace(a) / d
    spread = np.linalg.norm(a - mean * np.eye(d))
    if spread <= 4 * d * _EPS * np.linalg.norm(a):
        return None
    best, found = np.inf, None
    # the mean has an eigenvalue on each side; another shift serves where it meets one
    for shift in [mean + spread / d * f for f in (0.0, 0.11, -0.13, 0.29, -0.31, 0.53, -0.57)] + [np.median(np.diag(a))]:
        u = polar_factor(a - shift * np.eye(d))
        p = (u + np.eye(d)) / 2
        k = int(round(float(np.trace(p))))
        if not 0 < k < d:
            continue
        order = np.argsort(-np.diag(p), kind="stable")
        above, _ = np.linalg.qr(p @ p[:, order[:k]])  # two applications: the columns lie in the range of p
        below, _ = np.linalg.qr((np.eye(d) - p) @ (np.eye(d) - p)[:, order[k:]])
        basis, _ = np.linalg.qr(np.hstack([above, below]))
        above, below = basis[:, :k], basis[:, k:]
        error = np.linalg.norm(below.T @ a @ above)
        if error < best:
            best, found = error, (above, below)
        if error <= 8 * d * _EPS * np.linalg.norm(a):
            break
    return found


def eigen_by_projectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as columns) of a symmetric matrix by spectral division.

    Equal eigenvalues get an orthonormal basis of their subspace. A zero or empty matrix gives zeros.
    """
    a = np.asarray(matrix, float)
    d = len(a)
    done: list[tuple[float, np.ndarray]] = []
    todo = [np.eye(d)] if d else []
    while todo:
        basis = todo.pop()
        small = basis.T @ a @ basis
        small = (small + small.T) / 2
        parts = _split(small) if basis.shape[1] > 1 else None
        if parts is None:
            done += [(small[i, i], basis[:, i]) for i in range(basis.shape[1])]
        else:
            todo += [basis @ p for p in parts]
    done.sort(key=lambda e: -e[0])
    if not done:
        return np.empty(0), np.empty((0, 0))
    return np.array([e for e, _ in done]), _refined(a, np.stack([v for _, v in done], axis=1))


def _refined(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """One first-order correction of nearly exact eigenvectors; it removes the rounding of the levels above."""
    r = np.eye(len(a)) - v.T @ v
    s = v.T @ a @ v
    e = np.diag(s) / (1 - np.diag(r))
    gap = e[None, :] - e[:, None]
    apart = np.abs(gap) > 1e-7 * np.abs(e).max(initial=0.0)
    fix = np.where(apart, (s + r * e[None, :]) / np.where(apart, gap, 1.0), r / 2)
    q, r = np.linalg.qr(v + v @ fix)
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)


def _merge(a: tuple, b: tuple) -> tuple:
    """(n, mean, sum of centred products) of two sets of rows together."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _moments(rows: DataFrame, width: int, kernel) -> tuple | None:
    """(n, mean, sum of centred products) of kernel(x) over all rows.

    Every task gives one small matrix, centred before the products; they are folded on a fixed number of
    partitions first, so the driver adds up few of them.
    """

    def part(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                y = kernel(_matrix(batch.column(0), width))
                mean = y.mean(axis=0)
                y = y - mean
                now = (len(y), mean, y.T @ y)
                total = now if total is None else _merge(total, now)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"n": [total[0]], "mean": [total[1].tolist()], "products": [total[2].ravel().tolist()]})

    def fold(batches):
        total = None
        for batch in batches:
            for n, mean, products in zip(*(c.to_pylist() for c in batch.columns)):
                now = (n, np.array(mean), np.array(products).reshape(len(mean), -1))
                total = now if total is None else _merge(total, now)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"n": [total[0]], "mean": [total[1].tolist()], "products": [total[2].ravel().tolist()]})

    schema = "n long, mean array<double>, products array<double>"
    found = rows.select("x").mapInArrow(part, schema).repartition(8).mapInArrow(fold, schema).collect()  # at most 8 rows
    total = None
    for r in sorted(found):
        now = (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(len(r["mean"]), -1))
        total = now if total is None else _merge(total, now)
    return total


def whitened(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
             scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row a vector and component.

    Vectors that are null, empty, hold null or non-finite entries, or are not of the commonest length (the
    greater of tied ones) are left out and do not enter the statistics. Ids may be null or repeat: every row
    counts. Components whose eigenvalue is zero in double precision (below 1e-13 of the trace) have no
    whitened value and are not returned, so equal vectors alone give no rows, as does an empty table.
    `deviation` is exact; it is null beyond the range of a long. Other columns are not read.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & ~good)
    lengths = rows.groupBy(F.size(v).alias("width")).agg(F.count("*").alias("n"))
    widest = lengths.orderBy(F.desc("n"), F.desc("width")).first()
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if widest is None:
        return spark.createDataFrame([], out)
    width, n = widest["width"], widest["n"]
    x = rows.where(F.size(v) == width).select("vec_id", F.transform(v, lambda c: (F.floor(c * scale) + offset).cast("long")).alias("x"))
    # a sum per dimension as a column: one pass, exact, and the result has the width of a vector
    sums = [int(s) for s in x.select(*[F.sum(F.col("x")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)]).first()]
    mean = np.array([s / n for s in sums])
    _, shift, products = _moments(x, width, lambda m: m - mean)
    covariance = products / n
    values, basis = eigen_by_projectors(covariance)
    trace = float(np.trace(covariance))
    keep = [i for i in range(min(components, width)) if values[i] > 1e-13 * trace]
    if not keep:
        return spark.createDataFrame([], out)
    project = basis[:, keep] / np.sqrt(values[keep])
    share = [float(values[i] / trace) for i in keep]
    _, _, products = _moments(x, width, lambda m: (m - mean) @ project)
    error = float(np.abs(products / n - np.eye(len(keep))).max())
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches):
        total = np.array(sums, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(1), width)
            y = (m - mean) @ project
            whole = m.astype(np.int64)
            if (float(n) * np.abs(m - mean).max()) ** 2 * width < 2.0**62 and n * np.abs(m).max() < 2.0**62:
                exact = ((whole * n - total.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:  # Python integers where longs would overflow
                exact = [sum(int(g) ** 2 for g in row) for row in whole.astype(object) * n - total]
                exact = [e if e < 2**63 else None for e in exact]
            k = len(keep)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(len(m)), k)).cast(pa.int64()), pa.array(np.tile(np.array(keep, np.int32) + 1, len(m))),
                pa.array(np.full(len(m) * k, n)), pa.array([e for e in exact for _ in keep], pa.int64()), pa.array(y.ravel()),
                pa.array(np.tile(share, len(m))), pa.array(np.full(len(m) * k, error))], schema=schema).set_column(
                    0, "vec_id", batch.column(0).take(pa.array(np.repeat(np.arange(len(m)), k))).cast(pa.int64()))

    return x.mapInArrow(run, out)
