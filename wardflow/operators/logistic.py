"""Multinomial logistic regression by Newton steps (M1).

The objective is that of Spark ML's fit with ``standardization=False`` on features
of mean 0 and deviation 1: the weighted log loss plus ``1 / (2 C)`` times the squared
coefficients, intercepts left out.  L-BFGS takes a pass over the rows each of its
hundreds of evaluations and keeps them in memory; a Newton step takes one, over
packed blocks, whose gradient and curvature (``(k (d + 1))^2`` numbers) come to the
driver once a task.  Steps that do not lower the loss are halved.

Unknown values count as the mean, when fitted and when scored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.scalar import map_lookup
from wardflow.session import write_table

#: Rows of a block.
BLOCK = 4096


@dataclass
class Logistic:
    """Means and deviations of the features; a row of coefficients a class, the intercept last; classes with rows."""

    features: list[str]
    classes: list[str]
    means: np.ndarray
    scales: np.ndarray
    coefficients: np.ndarray
    known: np.ndarray

    def probabilities(self) -> Column:
        """Class shares of a row, in class order."""
        means, scales, w, known = self.means, self.scales, self.coefficients, self.known

        @F.arrow_udf("array<double>")
        def scores(*columns: pa.Array) -> pa.Array:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])
            p = np.zeros((len(x), len(w)))
            p[:, known] = _shares(_scaled(x, means, scales), w[known])
            ends = np.arange(len(x) + 1, dtype=np.int32) * p.shape[1]
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(p.ravel()))

        return scores(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in self.features])


def _scaled(x: np.ndarray, means: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Features in deviations from the mean, and a 1; unknown and constant features are 0."""
    out = np.ones((len(x), x.shape[1] + 1))
    np.subtract(x, means, out=out[:, :-1])
    out[:, :-1] *= np.where(scales > 0, 1 / np.where(scales > 0, scales, 1), 0)
    out[np.isnan(out)] = 0
    return out


def _logs(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log shares of the classes."""
    z = x @ w.T
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def _shares(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.exp(_logs(x, w))


def _blocks(rows: DataFrame, features: list[str], present: list[int]) -> DataFrame:
    """Blocks of rows: classes (places in ``present``), weights, and the values feature by feature, packed."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = np.stack([part.column(f).to_numpy(zero_copy_only=False).astype(np.float64) for f in features])
                yield pa.record_batch([pa.array([v.tobytes()], pa.binary()) for v in (
                    np.searchsorted(present, part.column("_y").to_numpy()).astype(np.int32), part.column("_w").to_numpy().astype(np.float64), x)], ["y", "w", "x"])

    return rows.mapInArrow(run, "y binary, w binary, x binary")


def _sums(blocks: DataFrame, means: np.ndarray, scales: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted log loss, its gradient and its curvature, over all rows."""
    (k, width), d = w.shape, len(means)

    def run(batches):
        loss, slope, curve = 0.0, np.zeros((k, width)), np.zeros((k, width, k, width))
        for b in batches:
            for yb, wb, xb in zip(*(b.column(c).to_pylist() for c in ("y", "w", "x")), strict=True):
                y, weight = np.frombuffer(yb, np.int32), np.frombuffer(wb, np.float64)
                x = _scaled(np.frombuffer(xb, np.float64).reshape(d, -1).T, means, scales)
                logs = _logs(x, w)
                loss -= weight @ logs[np.arange(len(y)), y]
                p = np.exp(logs)
                step = p.copy()
                step[np.arange(len(y)), y] -= 1
                slope += (step * weight[:, None]).T @ x
                for i in range(k):
                    for j in range(i + 1):
                        curve[i, :, j] += x.T @ (x * (weight * p[:, i] * ((i == j) - p[:, j]))[:, None])
        out = np.concatenate([[loss], slope.ravel(), curve.ravel()])
        yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], ["sums"])

    total = np.zeros(1 + k * width + (k * width) ** 2)
    for one in blocks.mapInArrow(run, "sums binary").toArrow().column("sums").to_pylist():  # one a task
        total += np.frombuffer(one, np.float64)
    curve = total[1 + k * width:].reshape(k, width, k, width)
    for i in range(k):
        for j in range(i):
            curve[j, :, i] = curve[i, :, j].T
    return float(total[0]), total[1:1 + k * width], curve.reshape(k * width, k * width)


def fit_logistic(train: DataFrame, features: list[str], label: str, classes: list[str], weight_col: str | None = None,
                 C: float = 1.0, max_iter: int = 1000, tol: float = 1e-9) -> Logistic:
    """The least of the objective, over the rows with a known label; a class without rows has a share of 0."""
    code = map_lookup({c: i for i, c in enumerate(classes)}, F.col(label), "int")
    known = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f) for f in features]
    rows = train.withColumn("_y", code).where("_y is not null").select(
        "_y", (F.col(weight_col).cast("double") if weight_col else F.lit(1.0)).alias("_w"), *known)
    stats = rows.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)],
                     *[F.stddev_samp(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    means = np.array([stats[f"m{i}"] or 0.0 for i in range(len(features))])
    scales = np.array([stats[f"s{i}"] or 0.0 for i in range(len(features))])
    masses = {r["_y"]: float(r["w"]) for r in rows.groupBy("_y").agg(F.sum("_w").alias("w")).collect() if (r["w"] or 0) > 0}
    if not masses:
        raise ValueError("no row has a known label and a weight")
    present = sorted(masses)
    blocks = write_table(_blocks(
        rows.where(F.col("_y").isin(present) & (F.col("_w") > 0))
        .select("_y", "_w", *[F.coalesce(F.col(f), F.lit(float("nan"))).alias(f) for f in features]), features, present))
    k, width = len(present), len(features) + 1
    w = np.zeros((k, width))
    w[:, -1] = np.log([masses[c] for c in present])
    w[:, -1] -= w[:, -1].mean()
    ridge = np.tile(np.append(np.full(width - 1, 1.0 / C), 0.0), k)

    def penalty(v: np.ndarray) -> float:
        return float((ridge * v.ravel() ** 2).sum() / 2)

    loss, slope, curve = _sums(blocks, means, scales, w)
    for _ in range(max_iter if k > 1 else 0):
        value, slope = loss + penalty(w), slope + ridge * w.ravel()
        # the intercepts have no ridge of their own and may all move alike: the least of such steps
        step = np.linalg.lstsq(curve + np.diag(ridge), -slope, rcond=1e-14)[0].reshape(k, width)
        falls, size = -float(slope @ step.ravel()), 1.0
        if falls <= tol * max(abs(value), math.ulp(1.0)):
            break
        while True:
            trial = w + size * step
            loss, slope, curve = _sums(blocks, means, scales, trial)
            if loss + penalty(trial) <= value - 1e-4 * size * falls:
                break
            size /= 2
            if size < 1e-6:
                trial = None
                break
        if trial is None:
            break
        w = trial
    out = np.zeros((len(classes), width))
    out[present] = w
    out[present, -1] -= w[:, -1].mean()
    return Logistic(list(features), list(classes), means, scales, out, np.array(present))
