"""Embedding whitening: exact scatter, pivoted Cholesky, one-sided Jacobi on the factor."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import by_value

by_value(__name__)

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
ROWS = 2048  # vectors multiplied at once
LIMB = 48  # bits of a limb of a sum that travels as longs
LARGEST = 2.0**54  # entries from here on have no x that sums safely as a long
_LONG = (1 << 63) - 1
_CELLS = "cell long, low long, mid long, high long"


def _integers(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.reshape(len(vectors), -1) * SCALE).astype(np.int64) + SHIFT


def _parts(batches, at: int = 0):
    """(batch of at most ROWS rows, its x-vectors)."""
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            yield part, _integers(part.column(at))


def _product(a: np.ndarray) -> np.ndarray:
    """a.T @ a of an integer matrix, exact, as Python integers."""
    top = int(np.abs(a).max(initial=0))
    if top * top * len(a) < 1 << 53:  # every partial sum is a whole double
        a = a.astype(np.float64)
        return (a.T @ a).astype(np.int64).astype(object)
    a = a.astype(object)
    return a.T @ a


def _limbs(total: np.ndarray) -> pa.RecordBatch:
    mask = (1 << LIMB) - 1
    columns = [total & mask, total >> LIMB & mask, total >> 2 * LIMB]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(total))), *[pa.array(c.astype(np.int64)) for c in columns]], names=["cell", "low", "mid", "high"]
    )


def _sums(batches):
    """A task's sum of x per dimension."""
    total = None
    for _, x in _parts(batches):
        own = x.sum(axis=0, dtype=np.int64) if int(np.abs(x).max()) < 1 << 50 else x.astype(object).sum(axis=0)
        total = own.astype(object) if total is None else total + own
    if total is not None:
        yield _limbs(total)


def _scatter(middle: np.ndarray):
    def run(batches):
        """A task's scatter around ``middle``: the upper triangle, row by row."""
        total = None
        for _, x in _parts(batches):
            own = _product(x - middle)
            total = own if total is None else total + own
        if total is not None:
            yield _limbs(total[np.triu_indices(len(total))])

    return run


def _added(vectors: DataFrame, task, cells: int) -> np.ndarray:
    """Sum the limbs of all tasks; ``cells`` rows reach the driver (they follow the dimensions, not the rows)."""
    limbs = ["low", "mid", "high"]
    found = vectors.mapInArrow(task, _CELLS).groupBy("cell").agg(*[F.sum(F.col(c).cast("decimal(19,0)")).alias(c) for c in limbs])
    out = np.zeros(cells, dtype=object)
    for r in found.toLocalIterator():
        out[r["cell"]] = sum(int(r[c]) << LIMB * i for i, c in enumerate(limbs))
    return out


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """F with F @ F.T = v, one column per pivot; taken in pivot order its rows are
    lower triangular. Stops where what is left of the diagonal is rounding error."""
    n = len(v)
    left, order = v.diagonal().copy(), np.arange(n)
    factor = np.zeros_like(v)
    least = 8 * n * np.finfo(v.dtype).eps * left.max(initial=0)
    for k in range(n):
        best = k + int(np.argmax(left[order[k:]]))
        order[[k, best]] = order[[best, k]]
        pivot, below = order[k], order[k + 1 :]
        if left[pivot] <= least:
            return factor[:, :k]
        factor[pivot, k] = np.sqrt(left[pivot])
        factor[below, k] = (v[below, pivot] - factor[below, :k] @ factor[pivot, :k]) / factor[pivot, k]
        left[below] -= factor[below, k] ** 2
    return factor


def orthogonal_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """One-sided Jacobi: rotate pairs of columns until all are orthogonal.

    A sweep meets every pair once, as a round robin whose rounds rotate
    disjoint pairs at once.
    """
    g = factor.copy()
    n = g.shape[1]
    seats = np.arange(n + n % 2)  # with an odd number, one column sits out each round
    eps = np.finfo(g.dtype).eps
    for _ in range(sweeps if n > 1 else 0):
        worst = 0.0
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            both = (p < n) & (q < n)
            p, q = p[both], q[both]
            a, b = g[:, p], g[:, q]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            unlike = np.abs(ab) / np.sqrt(aa * bb)
            worst = max(worst, float(unlike.max()))
            slant = np.where(unlike > eps, (bb - aa) / (2 * np.where(ab == 0, 1, ab)), np.inf)
            tangent = np.where(slant < 0, -1, 1) / (np.abs(slant) + np.sqrt(1 + slant * slant))
            cosine = 1 / np.sqrt(1 + tangent * tangent)
            sine = cosine * tangent
            g[:, p], g[:, q] = cosine * a - sine * b, sine * a + cosine * b
            seats = np.r_[seats[:1], seats[-1:], seats[1:-1]]
        if worst <= 8 * eps:
            break
    return g


def principal_components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a covariance, largest first.

    Rotated column norms of the factor give the eigenvalues, normalised columns
    the eigenvectors (largest entry positive). Directions without variance have
    no column. Equal eigenvalues keep any orthogonal basis of their space.
    """
    g = orthogonal_columns(pivoted_cholesky(v))
    values = (g * g).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    values, g = values[order], g[:, order] / np.sqrt(values[order])
    signs = np.sign(g[np.abs(g).argmax(axis=0), np.arange(g.shape[1])]) if g.size else np.ones(g.shape[1])
    return values, g * signs


def _deviations(d: np.ndarray, rest: np.ndarray, n: int) -> pa.Array:
    """Per row the sum of (n*x - S)^2, exact; null beyond a long."""
    top = n * int(np.abs(d).max(initial=0)) + int(np.abs(rest).max(initial=0))
    if top * top * d.shape[1] <= _LONG:
        return pa.array(((n * d - rest.astype(np.int64)) ** 2).sum(axis=1))
    exact = ((n * d.astype(object) - rest) ** 2).sum(axis=1)
    return pa.array([x if x <= _LONG else None for x in exact], pa.int64())


def _moments(middle, mean, axes):
    def run(batches):
        """A task's sums of whitened values and of their products."""
        k = axes.shape[1]
        total = np.zeros((k + 1, k))
        for _, x in _parts(batches):
            w = ((x - middle) - mean) @ axes
            total += np.r_[w.T @ w, w.sum(axis=0)[None]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "value"])

    return run


def _whitened(middle, rest, n, mean, axes, shares, error):
    def run(batches):
        k = axes.shape[1]
        for part, x in _parts(batches, 1):
            d = x - middle
            w = (d - mean) @ axes
            row = pa.array(np.repeat(np.arange(len(d)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(row),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(d))),
                    pa.array(np.full(w.size, n, dtype=np.int64)),
                    _deviations(d, rest, n).take(row),
                    pa.array(w.ravel()),
                    pa.array(np.tile(shares, len(d))),
                    pa.array(np.full(w.size, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per remaining vector and component: vec_id, component, n, deviation,
    whitened, explained, identity_error.

    Entries become x = floor(64 * entry) + 1000000. Rows go if their vector is
    null or empty, holds a null, NaN, infinite or immense entry (2^54 and up),
    or does not have the commonest length (of equal counts the longest). All
    others are fitted: sums and the scatter around the rounded mean are exact
    integers, added up per task and then per cell by Spark; only cells (their
    number follows the dimensions alone) reach the driver, which factors the
    covariance in extended precision. ``identity_error`` is measured over all
    whitened rows. Components without variance are left out, so equal vectors,
    one vector or an empty table give no rows; fewer dimensions than
    ``components`` give fewer components. Equal eigenvalues share a space in
    which any orthogonal axes are right. ``deviation`` is null where a long
    cannot hold it. A null id stays null; repeated rows stay; other columns are
    not read.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    whole = F.forall("vec", lambda e: F.coalesce(F.abs(e) < LARGEST, F.lit(False)))
    plain = plain.where((F.size("vec") > 0) & whole)  # NaN is larger than any number
    lengths = plain.groupBy(F.size("vec").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    schema = f"vec_id {plain.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not most:
        return spark.createDataFrame([], schema)
    n, dims = most[0]["n"], most[0]["dims"]
    plain = plain.where(F.size("vec") == dims)
    only = plain.select("vec")

    sums = _added(only, _sums, dims)
    middle = (sums // n).astype(np.int64)
    rest = sums % n  # S - n * middle
    scatter = np.zeros((dims, dims), dtype=object)
    upper = np.triu_indices(dims)
    scatter[upper] = _added(only, _scatter(middle), len(upper[0]))
    scatter = np.where(np.tri(dims, k=-1, dtype=bool), scatter.T, scatter)
    exact = n * scatter - np.outer(rest, rest)  # n^2 times the covariance
    wide = np.array([np.longdouble(int(c)) for c in exact.ravel()]).reshape(dims, dims)
    v = wide / np.longdouble(n) / np.longdouble(n)
    values, axes = principal_components(v)
    k = min(components, len(values))
    if k == 0:
        return spark.createDataFrame([], schema)
    shares = (values[:k] / v.trace()).astype(np.float64)
    axes = (axes[:, :k] / np.sqrt(values[:k])).astype(np.float64)
    mean = np.array([np.longdouble(int(r)) / n for r in rest]).astype(np.float64)  # of x - middle

    sent = only.mapInArrow(_moments(middle, mean, axes), "cell long, value double")
    moments = np.zeros((k + 1) * k)
    for r in sent.groupBy("cell").agg(F.sum("value").alias("value")).toLocalIterator():
        moments[r["cell"]] = r["value"]
    moments = moments.reshape(k + 1, k) / n
    error = float(np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max())
    return plain.mapInArrow(_whitened(middle, rest, n, mean, axes, shares, error), schema)


def op11_whitening(spark, sf_dir):
    return whiten(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
