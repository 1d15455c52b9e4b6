"""Whitening of vectors by a covariance weighted with multiplicities.

Entries become whole numbers, and vectors that are identical then form one class with a count. Sums
are exact; the covariance is a matrix product of centred class vectors weighted by their counts, a
partial product a task, added up row by row. Its eigenvectors are found on the driver, which holds one
matrix of dimension times dimension. Every class is whitened once and joined back to its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import in_arrow
from kerbside.session import cut_lineage

SCALE, SHIFT = 1024, 100_000  # x = floor(SCALE * c) + SHIFT
COMPONENTS = 8
FLAT = 1e-12  # a component whose share of the largest eigenvalue is no more has no spread
_LIMIT = float(1 << 62)


class Fit(NamedTuple):
    """What the fit list says: its size, sums per dimension, components as columns, their eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def whole_numbers(vector: Column) -> Column:
    """The x vector as array<bigint>; null where an entry is null, not finite or too large for it."""
    c = F.transform(vector, lambda v: v.cast("double") * SCALE)
    sound = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < _LIMIT))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & sound, F.transform(c, lambda v: F.floor(v) + SHIFT))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def classes_of(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """((vec_id, p, q) of every usable row, (p, q, x, copies) of every distinct x vector).

    Vectors of another length than the most frequent one (the longer of equally frequent ones) are
    left out like unusable ones: one covariance has one dimension.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), whole_numbers(F.col(vector_col)).alias("x")).where("x is not null")
    rows = rows.select("vec_id", "x", F.xxhash64("x").alias("p"), F.xxhash64(F.lit(1), "x").alias("q"))
    classes = cut_lineage(rows.groupBy("p", "q").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("copies")))
    lengths = classes.groupBy(F.size("x").alias("dim")).agg(F.sum("copies").alias("n"))
    usual = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    kept = F.size("x") == (usual["dim"] if usual else 0)
    return rows.where(kept).select("vec_id", "p", "q"), classes.where(kept)


def _sums(weighted: DataFrame) -> tuple[int, list[int]]:
    """Weight and exact weighted sums per dimension; a row per dimension comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x, w = _matrix(batch.column(0)), batch.column(1).to_numpy()
                part = [int(v) for v in w @ x] if np.abs(x).max() * float(w.sum()) < _LIMIT else [int(v) for v in w.astype(object) @ x.astype(object)]
                n, sums = n + int(w.sum()), part if sums is None else [a + b for a, b in zip(sums, part)]
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))],
                                             ["n", "sums"])

    parts = weighted.select("x", "weight").mapInArrow(run, "n long, sums array<string>")
    per_dim = parts.select("n", F.posexplode("sums").alias("dim", "s")).groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()
    return (per_dim[0]["n"] if per_dim else 0), [int(r["s"]) for r in per_dim]


def _covariance(weighted: DataFrame, mean: np.ndarray, n: int) -> np.ndarray:
    """Sum of weight * (x - mean) (x - mean)' by n: a centred product a task, added row by row."""
    d = len(mean)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = _matrix(batch.column(0)) - mean
            total += x.T @ (batch.column(1).to_numpy()[:, None] * x)
        if total.any():
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(d, task), pa.int32()), pa.array(np.arange(d), pa.int32()),
                pa.array(list(total), pa.list_(pa.float64()))], ["task", "row", "part"])

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("task")  # the same order in every run
        total = _matrix(rows["part"].combine_chunks()).sum(axis=0)
        return pa.table({"row": rows["row"][:1].cast(pa.int32()), "part": pa.array([total], pa.list_(pa.float64()))})

    parts = weighted.select("x", "weight").mapInArrow(products, "task int, row int, part array<double>")
    got = parts.groupBy("row").applyInArrow(add, "row int, part array<double>").toArrow()
    out = np.zeros((d, d))
    for row, part in zip(got["row"].to_pylist(), got["part"].to_pylist()):
        out[row] = part
    return (out + out.T) / (2 * n)


def fit(classes: DataFrame, components: int = COMPONENTS, weights: str = "counts") -> Fit:
    """Mean and leading components; ``weights`` is "counts" (all rows) or "one" (distinct vectors)."""
    weighted = classes.select("x", (F.col("copies") if weights == "counts" else F.lit(1).cast("long")).alias("weight"))
    n, sums = _sums(weighted)
    if not n:
        return Fit(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    v = _covariance(weighted, np.array([s / n for s in sums]), n)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = min(components, int((values > max(values[0], 0) * FLAT).sum()))
    vectors = vectors[:, :some]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(some)] < 0, -1, 1)
    return Fit(n, sums, vectors, values[:some], float(np.trace(v)))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n * x - S) ** 2, None where a long can't hold it."""
    if np.abs(x).max() * float(n) < _LIMIT and max(map(abs, sums)) < _LIMIT:
        far = x * np.int64(n) - np.array(sums, np.int64)
        if (far.astype(np.float64) ** 2).sum(axis=1).max() < _LIMIT:
            return (far * far).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def _whitened(classes: DataFrame, fitted: Fit) -> DataFrame:
    """(p, q, copies, deviation, y) of every class, y being its whitened vector."""
    n, sums = fitted.n, fitted.sums
    mean = np.array([s / n for s in sums])
    turn = fitted.components / np.sqrt(fitted.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(3))
                y = (x - mean) @ turn
                yield pa.RecordBatch.from_arrays([
                    *batch.columns[:3], pa.array(_deviations(x, n, sums), pa.int64()), pa.array(list(y), pa.list_(pa.float64()))],
                    ["p", "q", "copies", "deviation", "y"])

    return cut_lineage(in_arrow(classes.select("p", "q", "copies", "x"), run,
                                "p long, q long, copies long, deviation long, y array<double>"))


def identity_error(whitened: DataFrame, weight: Column, n: int, k: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    y = [F.get("y", F.lit(i)) for i in range(k)]
    mean = whitened.agg(*[F.sum(weight * v) / n for v in y]).first()
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    cov = whitened.agg(*[F.sum(weight * (y[i] - F.lit(mean[i])) * (y[j] - F.lit(mean[j]))) / n for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           weights: str = "counts") -> DataFrame:
    """One row per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or empty, hold null or non-finite entries or entries too large for a long, or
    have an unusual length (see ``classes_of``) are left out; zero vectors take part. Rows that repeat
    and rows without id count each. A component without spread (all rows equal, or fewer independent
    vectors than components) isn't returned, so a table of equal vectors, and an empty one, give no
    rows. ``deviation`` is null where it exceeds a long. Other columns are not read.
    """
    rows, classes = classes_of(vectors, id_col, vector_col)
    fitted = fit(classes, components, weights)
    k = len(fitted.values)
    if not k:
        return rows.where("false").select(
            "vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
            *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")])
    whitened = _whitened(classes, fitted)
    error = identity_error(whitened, F.col("copies") if weights == "counts" else F.lit(1), fitted.n, k)
    share = F.array(*[F.lit(float(v / fitted.trace)) for v in fitted.values])
    out = rows.join(whitened.select("p", "q", "deviation", "y"), ["p", "q"])
    out = out.select("vec_id", "deviation", F.posexplode("y").alias("_at", "whitened"))
    return out.select("vec_id", (F.col("_at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation",
                      "whitened", F.get(share, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"))
