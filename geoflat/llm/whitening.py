"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

1. Vectors become whole numbers (``floor(scale * c)``); rows without a full finite vector go.
   Each distinct vector counts once in the fit.
2. Their scatter is summed in whole numbers around the rounded mean, and the remainder of the
   mean is taken off as a fraction: the centred scatter is exact whatever the order of the tasks,
   and is rounded once. A task sends one d x d matrix; the matrices are added up in Spark.
3. Pivoted Cholesky gives the triangular factor L of the scatter (largest remaining diagonal
   first; it ends at the rank). One-sided Jacobi turns pairs of columns of L itself until all are
   orthogonal, so small eigenvalues keep their digits: squared column norms are the eigenvalues,
   normalised columns the components. Both work on d x d numbers, on the driver.
4. Every row is projected in Spark; the covariance of the whitened fit list is measured as well.

Defined cases: the dimension is that of most rows (the larger one on a tie); rows of another
dimension are dropped like null vectors. Components with the eigenvalue 0 (to the rounding of the
largest one) are not returned, so one distinct vector, equal vectors and an empty table give no rows. Repeated rows and rows with null
or equal ids are returned one by one. ``deviation`` is null where it needs more than 64 bits. Of the
other columns none is read, so none can clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (ArrayType, DecimalType, DoubleType, IntegerType, LongType, StructField,
                               StructType)

from .common import stored

SCALE = 256
COMPONENTS = 4
_SAFE = 2 ** 62


@dataclass
class Whitening:
    """``components`` are the columns of a matrix, by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L (d x rank) with ``a`` = L L^T; rows are in the order of ``a``, columns in pivot order."""
    d = len(a)
    rest = np.array(a, dtype=np.float64)
    limit = d * np.finfo(float).eps * max(rest.diagonal().max(initial=0.0), 0.0)
    columns, open_ = [], np.ones(d, dtype=bool)
    for _ in range(d):
        diagonal = np.where(open_, rest.diagonal(), -np.inf)
        p = int(np.argmax(diagonal))
        if not diagonal[p] > limit:
            break
        column = np.where(open_, rest[:, p], 0.0) / np.sqrt(diagonal[p])
        column[p] = np.sqrt(diagonal[p])
        rest -= np.outer(column, column)
        open_[p] = False
        columns.append(column)
    return np.array(columns).T.reshape(d, -1)


def _rounds(n: int):
    """Pairings of n columns (n even), every pair once."""
    ring = list(range(1, n))
    for k in range(n - 1):
        order = [0, *ring[k:], *ring[:k]]
        yield np.array(order[:n // 2]), np.array(order[:n // 2 - 1:-1])


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors and eigenvalues of ``factor factor^T`` by rotating pairs of its columns; the
    pairs of a round share no column and turn together."""
    d, rank = factor.shape
    work = np.zeros((d, rank + rank % 2))
    work[:, :rank] = factor
    small = np.finfo(float).eps
    for _ in range(sweeps if rank > 1 else 0):
        turned = False
        for p, q in _rounds(work.shape[1]):
            x, y = work[:, p], work[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            on = np.abs(c) > small * np.sqrt(a * b)
            if not on.any():
                continue
            turned = True
            safe = np.where(on, c, 1.0)
            z = (b - a) / (2 * safe)
            t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.sqrt(1 + z * z))
            cos = np.where(on, 1 / np.sqrt(1 + t * t), 1.0)
            sin = np.where(on, cos * t, 0.0)
            work[:, p], work[:, q] = cos * x - sin * y, sin * x + cos * y
        if not turned:
            break
    norms = np.sqrt((work * work).sum(0))
    order = np.argsort(-norms, kind="stable")[:rank]
    order = order[norms[order] > 0]
    return work[:, order] / norms[order], norms[order] ** 2


def whole_vectors(rows: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """The rows with a full finite vector of the common dimension, with ``x``, its whole numbers;
    other columns go into ``row``."""
    v = F.col(f"`{vector}`")
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != vector] or [F.lit(0).alias("_")])
    number = lambda c: c.cast("double")
    good = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(number(c)) & (F.abs(number(c)) < float("inf")))
    sizes = rows.where(good).groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    d = most["d"] if most else 0
    return rows.where(good & (F.size(v) == d)).select(
        row.alias("row"), F.transform(v, lambda c: F.floor(number(c) * scale).cast("bigint")).alias("x"))


def _matrix(column) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    values = np.asarray(column.flatten(), dtype=np.int64)
    return values.reshape(len(column), -1)


def _exact(a: np.ndarray, bound: int) -> np.ndarray:
    """As it is when results up to ``bound`` fit in 64 bits, else as Python numbers."""
    return a if bound < _SAFE else a.astype(object)


def _column_sums(batches, schema: pa.Schema):
    """Exact sums of each dimension."""
    total, n = None, 0
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            n += len(x)
            high = int(max(abs(int(x.max())), abs(int(x.min()))))
            part = _exact(x, high * len(x)).sum(axis=0)
            total = [int(v) for v in part] if total is None else [a + int(v) for a, v in zip(total, part, strict=True)]
    if n:
        yield _entries([-1, *range(len(total))], [-1] * (len(total) + 1), [n, *total], schema)


def _scatter(batches, centre: list[int], schema: pa.Schema):
    """Exact sums of the products of each two dimensions, around ``centre``."""
    total = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(0))
        reach = max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, centre))
        if reach ** 2 * len(x) < 2 ** 53:  # whole numbers that doubles hold exactly
            y = (x - np.array(centre)).astype(np.float64)
            part = (y.T @ y).astype(np.int64).astype(object)
        else:
            y = x.astype(object) - np.array(centre, dtype=object)
            part = y.T @ y
        total = part if total is None else total + part
    if total is not None:
        i, j = np.triu_indices(len(centre))
        yield _entries(i, j, [int(v) for v in total[i, j]], schema)


def _entries(i, j, values: list[int], schema: pa.Schema) -> pa.RecordBatch:
    """Numbers of any size, as a high and a low part."""
    return pa.RecordBatch.from_arrays(
        [pa.array(list(i), pa.int32()), pa.array(list(j), pa.int32()),
         pa.array([v >> 40 for v in values], pa.decimal128(38, 0)),
         pa.array([v & (2 ** 40 - 1) for v in values], pa.int64())], schema=schema)


_ENTRY = StructType([StructField("i", IntegerType()), StructField("j", IntegerType()),
                     StructField("high", DecimalType(38, 0)), StructField("low", LongType())])


def _added(entries: DataFrame) -> dict[tuple[int, int], int]:
    """Sums per place, in Spark; at most d x d numbers reach the driver."""
    rows = entries.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    return {(r["i"], r["j"]): (int(r["high"]) << 40) + int(r["low"]) for r in rows.collect()}


def fit(distinct: DataFrame) -> Whitening | None:
    """From a cheaply reread table of distinct vectors ``x``; None without any."""
    entry = to_arrow_schema(_ENTRY)
    vectors = distinct.select("x")
    sums = _added(vectors.mapInArrow(lambda it: _column_sums(it, entry), _ENTRY))
    n = sums.pop((-1, -1), 0)
    if not n or not sums:
        return None
    s = [sums[i, -1] for i in range(len(sums))]
    centre = [round(Fraction(v, n)) for v in s]
    found = _added(vectors.mapInArrow(lambda it: _scatter(it, centre, entry), _ENTRY))
    left = [v - n * c for v, c in zip(s, centre, strict=True)]
    v = np.empty((len(s), len(s)))
    for (i, j), total in found.items():
        v[i, j] = v[j, i] = float((total - Fraction(left[i] * left[j], n)) / n)
    components, values = one_sided_jacobi(pivoted_cholesky(v))
    return Whitening(n, s, components, values, float(v.trace()))


def _moments(batches, model: Whitening, k: int, schema: pa.Schema):
    """Count, means and centred products of the whitened vectors of a task."""
    n, mean, scatter = 0, np.zeros(k), np.zeros((k, k))
    for batch in batches:
        if batch.num_rows:
            w = project(_matrix(batch.column(0)), model, k)
            m, shift = len(w), w.mean(axis=0) - mean
            y = w - w.mean(axis=0)
            scatter += y.T @ y + np.outer(shift, shift) * n * m / (n + m)
            mean, n = mean + shift * m / (n + m), n + m
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())),
             pa.array([scatter.reshape(-1).tolist()], pa.list_(pa.float64()))], schema=schema)


def project(x: np.ndarray, model: Whitening, k: int) -> np.ndarray:
    return ((x - model.mean) @ model.components[:, :k]) / np.sqrt(model.eigenvalues[:k])


def identity_error(distinct: DataFrame, model: Whitening, k: int) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity."""
    out = StructType([StructField("n", LongType()), StructField("mean", ArrayType(DoubleType())),
                      StructField("scatter", ArrayType(DoubleType()))])
    arrow = to_arrow_schema(out)
    parts = distinct.select("x").mapInArrow(lambda it: _moments(it, model, k, arrow), out)
    # about each part's own mean, then about the common one: k + k x k numbers are summed
    mean = parts.agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col("mean")[i]).alias(f"m{i}") for i in range(k)])
    head = mean.first()
    centre = [head[f"m{i}"] / head["n"] for i in range(k)]

    def entry(i, j):
        apart = F.col("n") * (F.col("mean")[i] - F.lit(centre[i])) * (F.col("mean")[j] - F.lit(centre[j]))
        return F.abs(F.sum(F.col("scatter")[i * k + j] + apart) / F.lit(float(head["n"])) - F.lit(float(i == j)))

    return float(max(parts.agg(*[entry(i, j).alias(f"{i}_{j}") for i in range(k) for j in range(k)]).first()))


def _whitened(batches, model: Whitening, k: int, schema: pa.Schema):
    d = len(model.sums)
    sums = np.array(model.sums, dtype=object)
    for batch in batches:
        x = _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, d), dtype=np.int64)
        high = int(max(abs(int(x.max())), abs(int(x.min())))) if len(x) else 0
        reach = model.n * high + max(map(abs, model.sums))
        if reach ** 2 * d < _SAFE:
            y = model.n * x - sums.astype(np.int64)
            deviation = (y * y).sum(axis=1).tolist()
        else:
            deviation = [int(((model.n * r.astype(object) - sums) ** 2).sum()) for r in x]
        deviation = [v if v < 2 ** 63 else None for v in deviation]
        w = project(x, model, k)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(deviation, pa.int64()),
             pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(x) + 1, k), pa.int32()),
                                      pa.array(w.reshape(-1), pa.float64()))], schema=schema)


def whiten(rows: DataFrame, vector: str = "embedding", k: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Per remaining row and component up to ``k``: ``row`` (the other columns), ``component``
    (from 1), ``n, deviation, whitened, explained, identity_error``."""
    whole = whole_vectors(rows, vector, scale)
    distinct = stored(whole.select("x").distinct())
    model = fit(distinct)
    known = min(k, len(model.eigenvalues)) if model else 0
    out = StructType([whole.schema["row"], StructField("deviation", LongType()),
                      StructField("w", ArrayType(DoubleType()))])
    arrow = to_arrow_schema(out)
    if known:
        error = identity_error(distinct, model, known)
        shares = [float(e / model.trace) for e in model.eigenvalues[:known]]
        done = whole.mapInArrow(lambda it: _whitened(it, model, known, arrow), out)
    else:
        error, shares = 0.0, [0.0]
        done = whole.limit(0).select("row", F.lit(0).cast("bigint").alias("deviation"),
                                     F.array(F.lit(0.0)).alias("w"))
    each = done.select("row", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        "row", (F.col("at") + 1).alias("component"), F.lit(model.n if known else 0).cast("bigint").alias("n"),
        "deviation", "whitened", F.array(*map(F.lit, shares))[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"))
