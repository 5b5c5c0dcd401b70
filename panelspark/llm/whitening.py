"""Whitening of embeddings by their leading principal components.

The covariance is summed by the tasks over centred vectors. Only that square
matrix reaches the driver, where Householder reflections make it tridiagonal,
Sturm counts bisect its leading eigenvalues, and inverse iteration finds their
vectors, orthogonal to earlier ones of the same cluster of eigenvalues. The
projection goes back to the tasks. The matrix is as large as vectors are long,
however many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import saved

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: The longest vectors taken: their covariance must fit in the driver.
MAX_DIMENSION = 4_096
MAX_ENTRY = float(1 << 54)
#: Eigenvalues this close, against the largest, are a cluster.
CLUSTER = 1e-3
EPS = np.finfo(float).eps


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, the one beside it, and the unit vectors of the reflections, of a symmetric matrix by Householder's method."""
    a, reflections = np.array(matrix, dtype=float), []
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(x)
        v = x / size if size > 0 else x
        reflections.append(v)
        # Both sides of the rest at once: A - vw' - wv'.
        p = 2 * (a[k + 1 :, k + 1 :] @ v)
        w = p - (p @ v) * v
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def smaller(diagonal: np.ndarray, beside: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues are below each x: the negative pivots (Sturm's sequence)."""
    tiny = max(EPS * max(np.abs(diagonal).max(), np.abs(beside).max(initial=0)), np.finfo(float).tiny) * EPS
    q, count = np.ones_like(x), np.zeros(len(x), dtype=np.int64)
    for d, e in zip(diagonal, np.append(0.0, beside), strict=True):
        q = d - x - e * e / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, beside: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each by bisection of its own interval until no number lies between its ends."""
    n = len(diagonal)
    reach = np.append(np.abs(beside), 0) + np.append(0, np.abs(beside))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    slack = 2 * EPS * max(np.abs(low).max(), np.abs(high).max()) + np.finfo(float).tiny
    low, high = low - slack, high + slack
    rank = n - 1 - np.arange(k)  # of each value, from the smallest on
    for _ in range(2_000):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        below = smaller(diagonal, beside, middle) > rank
        high, low = np.where(below, middle, high), np.where(below, low, middle)
    return low + (high - low) / 2


def _solve(diagonal: np.ndarray, beside: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """The solution of (T - shift) x = right by elimination with row exchanges; a pivot of zero counts as tiny."""
    n = len(diagonal)
    first, second, third = diagonal - shift, np.append(beside, 0.0), np.zeros(n)
    right = right.copy()
    for i in range(n - 1):
        under, own = beside[i], (first[i + 1], second[i + 1])
        if abs(under) > abs(first[i]):
            factor = first[i] / under
            first[i + 1], second[i + 1] = second[i] - factor * own[0], third[i] - factor * own[1]
            first[i], second[i], third[i] = under, own[0], own[1]
            right[i], right[i + 1] = right[i + 1], right[i] - factor * right[i + 1]
        else:
            first[i] = first[i] if abs(first[i]) > tiny else tiny
            factor = under / first[i]
            first[i + 1], right[i + 1] = own[0] - factor * second[i], right[i + 1] - factor * right[i]
    x = np.zeros(n + 2)
    for i in range(n - 1, -1, -1):
        x[i] = (right[i] - second[i] * x[i + 1] - third[i] * x[i + 2]) / (first[i] if abs(first[i]) > tiny else tiny)
        if abs(x[i]) > 1e150:  # only the direction counts
            x, right = x / abs(x[i]), right / abs(x[i])
    return x[:n]


def _clear(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """x without its parts along the others, of length one; twice, so that nothing is left of them."""
    for _ in range(2):
        for o in others:
            x = x - (o @ x) * o
    return x / np.linalg.norm(x)


def vectors_of(diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the given falling eigenvalues, as columns."""
    scale = max(np.abs(values).max(), np.abs(diagonal).max(), np.abs(beside).max(initial=0), EPS)
    rng, found, cluster = np.random.default_rng(0), [], []
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * scale:
            cluster = []
        # Values that agree are parted a little, or the same vector would come again.
        shift = value - EPS * scale * len(cluster)
        x = _clear(rng.standard_normal(len(diagonal)), cluster)
        for _ in range(5):
            x = _clear(_solve(diagonal, beside, shift, x, EPS * scale), cluster)
        cluster.append(x)
        found.append(x)
    return np.array(found).T


def principal(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    size = np.abs(matrix).max() or 1.0
    diagonal, beside, reflections = tridiagonal(matrix / size)
    values = leading_values(diagonal, beside, k)
    vectors = vectors_of(diagonal, beside, values)
    for i in range(len(reflections) - 1, -1, -1):
        v = reflections[i]
        vectors[i + 1 :] -= 2 * np.outer(v, v @ vectors[i + 1 :])
    return values * size, vectors


def points(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): usable vectors as whole numbers, floor(64 c) + 1,000,000.

    Rows whose vector is null or empty or holds null or non-finite entries are
    left out, and so are those with entries of 2^54 and more, which would not
    fit into long numbers.
    """
    values = F.col("embedding").cast("array<double>")
    usable = (F.size("embedding") > 0) & F.forall(values, lambda c: F.coalesce(F.abs(c) < MAX_ENTRY, F.lit(False)))
    return embeddings.filter(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(values, lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _matrix(batch: pd.Series) -> np.ndarray:
    return np.stack(batch.to_numpy())


def products(rows: DataFrame, column: str, centred: Callable[[np.ndarray], np.ndarray], d: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products of what ``centred`` makes of a column of arrays: each task sums its own rows first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d + 1, d))
        for pdf in batches:
            y = centred(_matrix(pdf[column]))
            total[:d] += y.T @ y
            total[d] += y.sum(axis=0)
        yield pd.DataFrame({"i": np.arange(d + 1), "sums": list(total)})

    parts = rows.select(column).mapInPandas(run, "i int, sums array<double>").select("i", F.posexplode("sums").alias("j", "v"))
    out = np.zeros((d + 1, d))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out[d], out[:d]


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    embeddings has vec_id and embedding; other columns are ignored. Rows
    without a usable vector (see :func:`points`) are left out, and so are
    vectors of another length than most (of lengths as frequent, the shortest
    counts), which no covariance could hold. Repeated rows count as often as
    they stand there; a null vec_id stays null. Eigenvalues that are zero, to
    rounding, give no component: nothing can be divided by them. So equal
    vectors, a single one or an empty table give no rows. ``deviation`` is
    exact, and null where a long can't hold it. Tables of vectors longer than
    ``MAX_DIMENSION`` are refused.
    """
    empty = embeddings.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = saved(points(embeddings), "whiten-points")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return empty
    d, n = lengths[0]["d"], lengths[0]["count"]
    if d > MAX_DIMENSION:
        raise ValueError(f"vectors of {d} entries; at most {MAX_DIMENSION} are taken")
    rows = rows.filter(F.size("x") == d)
    summed = rows.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
    sums, reach = [0] * d, 0
    for r in summed:
        sums[r["j"]] = int(r["s"])
    for r in summed:
        reach = max(reach, abs(n * r["low"] - sums[r["j"]]), abs(n * r["high"] - sums[r["j"]]))
    # The whole part of the mean is taken away as a whole number, so nothing is rounded before the rest is.
    base = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    left = np.array([s % n for s in sums], dtype=object if reach >= 2**63 else np.int64)

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - base).astype(float) - rest

    drift, square = products(rows, "x", centred, d)
    covariance = square / n - np.outer(drift, drift) / n / n
    covariance = (covariance + covariance.T) / 2
    trace = float(np.trace(covariance))
    values, vectors = principal(covariance, min(components, d))
    kept = int((values > values[0] * d * EPS * 8).sum()) if trace > 0 else 0
    if not kept:
        return empty
    values, vectors = values[:kept], vectors[:, :kept]
    projection = vectors / np.sqrt(values)
    exact = d * reach * reach < 2**63

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _matrix(pdf["x"])
            away = x - base
            if exact:
                deviation = ((n * away - left) ** 2).sum(axis=1)
            else:
                deviation = [int(v) if v < 2**63 else None for v in ((n * away.astype(object) - left.astype(object)) ** 2).sum(axis=1)]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "deviation": pd.array(deviation, dtype="Int64"), "whitened": list(centred(x) @ projection)})

    own = rows.select(F.col("vec_id").cast("string").alias("vec_id"), "x").mapInPandas(project, "vec_id string, deviation long, whitened array<double>")
    own = saved(own.withColumn("vec_id", F.col("vec_id").cast("long")), "whiten-projected")
    drift, square = products(own, "whitened", lambda w: w, kept)
    error = float(np.abs(square / n - np.outer(drift, drift) / n / n - np.eye(kept)).max())
    explained = F.element_at(F.array(*[F.lit(float(v / trace)) for v in values]), F.col("component"))
    out = own.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).withColumn("component", F.col("place") + 1)
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
