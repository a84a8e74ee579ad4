"""A logistic ranker with isotonic calibration, fitted over whole groups."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.operators.evaluate import folds
from orderloom.session import cut

#: Newton steps end when no coefficient moves by more than this; most passes over the rows.
NEAR, PASSES = 1e-9, 100


@dataclass(frozen=True)
class Logistic:
    """Coefficients of the features, the intercept last."""

    coefficients: list[float]


def _sums(rows: DataFrame, points: dict[int, np.ndarray], weights: dict[int, dict[float, float]]) -> dict[int, np.ndarray]:
    """Weighted loss, gradient and curvature at each model's point over the rows outside its fold, summed by task: one pass for all models.

    rows: features, label and fold as doubles, in this order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(points, 0.0)
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            every, label, fold = np.column_stack([*cols[:-2], np.ones(batch.num_rows)]), cols[-2], cols[-1]
            for m, b in points.items():
                x, y = every[fold != m], label[fold != m]
                z, w = x @ b, np.where(y == 1, weights[m][1], weights[m][0])
                p = 1 / (1 + np.exp(-z))
                curve = x.T @ (x * (w * p * (1 - p))[:, None])
                total[m] = total[m] + np.concatenate([[np.sum(w * (np.logaddexp(0, z) - y * z))], x.T @ (w * (p - y)), curve.ravel()])
        have = [m for m in points if not np.isscalar(total[m])]
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int64()), pa.array([total[m].tolist() for m in have], pa.list_(pa.float64()))], names=["m", "v"])

    out: dict[int, np.ndarray] = {}
    for m, v in rows.mapInArrow(run, "m long, v array<double>").collect():
        out[m] = out.get(m, 0.0) + np.array(v)
    return out


def _fit(rows: DataFrame, features: list[str], label: str, strength: float, left_out: list[int]) -> dict[int, Logistic]:
    """A model per fold that is left out (one that no row has: of all rows), by Newton steps that are halved while the loss rises.

    Rows that are left have one class only: no model of it.
    """
    ready = rows.select(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"_{i}") for i, f in enumerate(features)), F.col(label).cast("double").alias("_label"), F.col("fold").cast("double").alias("_fold"))
    counts = {(r[0], r[1]): r[2] for r in ready.groupBy("_fold", "_label").count().collect()}
    of = {m: {k: sum(n for (fold, y), n in counts.items() if fold != m and y == k) for k in (0, 1)} for m in left_out}
    weights = {m: {k: (c[0] + c[1]) / (2.0 * c[k]) for k in (0, 1)} for m, c in of.items() if c[0] and c[1]}
    n = len(features) + 1
    at = {m: np.zeros(n) for m in weights}
    points, loss, way, done = dict(at), dict.fromkeys(weights, np.inf), {}, {}
    for _ in range(PASSES):
        if not points:
            break
        for m, v in _sums(ready, points, weights).items():
            b = points[m]
            now = v[0] + b @ b / (2 * strength)
            if now <= loss[m] + 1e-12 * abs(now):
                at[m], loss[m] = b, now
                way[m] = -np.linalg.solve(v[1 + n :].reshape(n, n) + np.eye(n) / strength, v[1 : 1 + n] + b / strength)
            else:
                way[m] = way[m] / 2
            points[m] = at[m] + way[m]
            if np.abs(way[m]).max() < NEAR:
                done[m] = Logistic([float(x) for x in points.pop(m)])
    if points:
        raise ValueError(f"no fit in {PASSES} passes")
    return done


def fit_logistic(rows: DataFrame, features: list[str], label: str = "label", strength: float = 1.0) -> Logistic:
    """L2 logistic regression with balanced classes whose intercept is penalised too."""
    found = _fit(rows.withColumn("fold", F.lit(0)), features, label, strength, [-1])
    if not found:
        raise ValueError("a ranker needs both classes")
    return found[-1]


def predict(model: Logistic, rows: DataFrame, features: list[str], calibration: IsotonicRegressionModel | None = None, name: str = "probability") -> DataFrame:
    """Adds the probability from 0 to 1: a dot product, calibrated where a calibration is given."""
    weights = model.coefficients
    dot = F.lit(weights[-1])
    for f, w in zip(features, weights, strict=False):
        dot = dot + F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * w
    scored = rows.withColumn(name, 1 / (1 + F.exp(-dot)))
    if calibration is not None:
        scored = calibration.transform(scored.withColumnRenamed(name, "_raw")).withColumnRenamed("prediction", name).drop("_raw")
    return scored.withColumn(name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(name))))


def out_of_fold(rows: DataFrame, features: list[str], group: str, label: str = "label", count: int = 3) -> DataFrame:
    """Each row's probability by a model that saw none of its group. A fold whose rest has one class is left out."""
    dealt = cut(rows.join(folds(rows, group, count).select(group, "fold"), group), "folds")
    models = _fit(dealt, features, label, 1.0, list(range(count)))
    parts = [predict(models[k], dealt.where(F.col("fold") == k), features) for k in sorted(models)]
    if not parts:
        raise ValueError("no fold could be fitted")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def calibrate(scored: DataFrame, label: str = "label") -> IsotonicRegressionModel:
    """Isotonic regression of label on probability; it is clipped to what was seen."""
    return IsotonicRegression(isotonic=True, featuresCol="_raw", labelCol="_y").fit(scored.select(F.col("probability").alias("_raw"), F.col(label).cast("double").alias("_y")))


def fit_calibrated(rows: DataFrame, features: list[str], group: str, label: str = "label") -> tuple[Logistic, IsotonicRegressionModel]:
    """The ranker on all rows, calibrated by scores that no model made of its own group."""
    held = out_of_fold(rows, features, group, label)
    return fit_logistic(rows, features, label), calibrate(held, label)
