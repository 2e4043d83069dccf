"""Logistic regressions of all labels at once: one pass over the rows per step, whatever the number of labels."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.tables import pin

#: Step lengths tried for every label in the same pass.
STEPS = (1.0, 0.25, 0.05)
#: Earlier steps that tell about the curvature.
MEMORY = 10


@dataclass(frozen=True)
class Logistic:
    """Coefficients of all labels as rows of a matrix, the intercept last."""

    labels: tuple[str, ...]
    weights: np.ndarray

    def probabilities(self, x: Column) -> Column:
        """All labels' probabilities of a feature vector as one array: a matrix product per Arrow batch."""
        weights = self.weights

        @F.arrow_udf("array<double>")
        def product(vectors: pa.Array) -> pa.Array:
            rows = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
            p = 1 / (1 + np.exp(-(rows @ weights[:, :-1].T + weights[:, -1])))
            ends = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * len(weights))
            return pa.ListArray.from_arrays(ends, pa.array(p.ravel()))

        return product(vector_to_array(x))


def _matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x, y = (batch[c].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("x", "y"))
    return np.c_[x.astype(float), np.ones(batch.num_rows)], y.astype(float)


def _sums(rows: DataFrame, of_batch, size: int) -> np.ndarray:
    """Sums of `of_batch(x, y)` over all rows: per task in place, then by position as any grouped sum."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of_batch(*_matrices(batch))
        yield pa.record_batch([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["at", "value"])

    parts = rows.mapInArrow(work, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[parts["at"].to_numpy()] = parts["value"].to_numpy()
    return out


def _losses(thetas: np.ndarray, positive: np.ndarray, negative: np.ndarray):
    """Loss and gradient of every label at every trial point, as one flat vector."""
    def of_batch(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        weight = np.where(y == 1, positive, negative)
        out = []
        for theta in thetas:
            z = x @ theta.T
            out += [(weight * (np.logaddexp(0, z) - y * z)).sum(0), ((weight * (1 / (1 + np.exp(-z)) - y)).T @ x).ravel()]
        return np.concatenate(out)

    return of_batch


def _direction(g: np.ndarray, steps: list, changes: list, first: np.ndarray) -> np.ndarray:
    """Two-loop recursion of limited-memory quasi-Newton steps, started from the curvature `first`."""
    q, kept = g.copy(), []
    for s, d in zip(reversed(steps), reversed(changes)):
        a = s @ q / (s @ d)
        q -= a * d
        kept.append(a)
    q = first @ q
    if steps:
        q *= (steps[-1] @ changes[-1]) / (changes[-1] @ first @ changes[-1])
    for (s, d), a in zip(zip(steps, changes), reversed(kept)):
        q += s * (a - d @ q / (s @ d))
    return -q


def fit(df: DataFrame, x: str, labels: list[str], balanced: bool, iterations: int = 100, c: float = 1.0, tolerance: float = 1e-8) -> Logistic:
    """Ridge logistic regressions of 0/1 columns on a vector column; inverse strength `c` on the summed loss, free intercepts.

    `balanced` weighs both classes equally. Labels with one class are left out. Each iteration is one pass that sums losses and
    gradients (trial steps x labels x features) of all labels per Arrow batch; every label takes its own longest step that lowers its
    loss enough, and rests once its gradient is below `tolerance` per row. The curvature starts from one matrix of feature products
    shared by all labels. Rows with a null label or feature are left out.
    """
    rows = df.select(vector_to_array(F.col(x)).alias("x"), F.array(*[F.col(v).cast("tinyint") for v in labels]).alias("y"))
    rows = pin(rows.where(F.col("x").isNotNull() & ~F.exists("y", lambda v: v.isNull()) & ~F.exists("x", F.isnan)))
    first = rows.select(F.size("x")).first()
    if first is None:
        return Logistic((), np.zeros((0, 1)))
    width, count = first[0] + 1, len(labels)
    found = _sums(rows, lambda m, y: np.concatenate([(m.T @ m).ravel(), y.sum(0)]), width * width + count)
    products, positives = found[:width * width].reshape(width, width), found[width * width:]
    n = products[-1, -1]
    both = (positives > 0) & (positives < n)
    half = np.where(both, positives, n / 2)
    positive, negative = (n / (2 * half), n / (2 * (n - half))) if balanced else (np.ones(count), np.ones(count))
    ridge = np.r_[np.full(width - 1, 1 / c), 0.0]
    curve = np.linalg.inv(products / 4 + np.diag(ridge) + 1e-9 * n * np.eye(width))

    def at(thetas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = _sums(rows, _losses(thetas, positive, negative), len(thetas) * count * (width + 1)).reshape(len(thetas), -1)
        loss, slope = flat[:, :count], flat[:, count:].reshape(len(thetas), count, width)
        return loss + (thetas * thetas * ridge).sum(2) / 2, slope + thetas * ridge

    theta = np.zeros((count, width))
    loss, slope = (v[0] for v in at(theta[None]))
    steps, changes = [[] for _ in labels], [[] for _ in labels]
    open_ = both.copy()
    for _ in range(iterations):
        open_ &= np.abs(slope).max(1) > tolerance * n
        if not open_.any():
            break
        way = np.stack([_direction(slope[i], steps[i], changes[i], curve) if open_[i] else np.zeros(width) for i in range(count)])
        trial = np.stack([theta + t * way for t in STEPS])
        losses, slopes = at(trial)
        for i in np.flatnonzero(open_):
            down = way[i] @ slope[i]
            fits = [k for k, t in enumerate(STEPS) if losses[k, i] <= loss[i] + 1e-4 * t * down]
            k = fits[0] if fits else int(losses[:, i].argmin())
            if not fits and losses[k, i] >= loss[i]:
                if not steps[i]:
                    open_[i] = False  # nothing lower within rounding
                steps[i], changes[i] = [], []
                continue
            s, d = trial[k, i] - theta[i], slopes[k, i] - slope[i]
            if s @ d > 1e-14 * np.sqrt((s @ s) * (d @ d)):
                steps[i], changes[i] = [*steps[i], s][-MEMORY:], [*changes[i], d][-MEMORY:]
            theta[i], loss[i], slope[i] = trial[k, i], losses[k, i], slopes[k, i]
    return Logistic(tuple(v for v, b in zip(labels, both) if b), theta[both])
