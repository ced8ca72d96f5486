"""Linear models over feature arrays: Spark's own distributed solvers, and trust-region Newton steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.plans.lineage import checkpointed


def train_linear(rows: DataFrame, x_col: str = "x", y_col: str = "y", kind: str = "logistic", strength: float = 0.01, steps: int = 50):
    """BLA-1 (M): a logistic regression or a linear support vector machine on ``array<double>``."""
    maker = {"logistic": LogisticRegression, "svm": LinearSVC}[kind]
    ready = rows.select(array_to_vector(F.col(x_col)).alias("features"), F.col(y_col).cast("double").alias("label"))
    return maker(maxIter=steps, regParam=strength).fit(ready)


def predict_linear(model, rows: DataFrame, x_col: str = "x") -> DataFrame:
    """BLA-1 (M): ``rows`` with the ``predicted`` class."""
    out = model.transform(rows.withColumn("features", array_to_vector(F.col(x_col))))
    return out.select(*rows.columns, F.col("prediction").cast("int").alias("predicted"))


@dataclass
class Newton:
    """A fitted model: the weights (the bias last), and the loss after each step."""

    weights: np.ndarray
    losses: list[float]


def _batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Features with a one behind them, and labels as -1 and 1."""
    y = np.where(batch.column("y").to_numpy() > 0, 1.0, -1.0)
    x = batch.column("x").flatten().to_numpy().reshape(len(y), -1)
    return np.hstack((x, np.ones((len(y), 1)))), y


def _summed(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """A vector summed over all rows: one array a task, added up by place."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(*_batch(batch))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "value"])

    sums = rows.mapInArrow(partial, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    return np.array([r["value"] for r in sums.orderBy("at").collect()])


def newton(rows: DataFrame, x_col: str = "x", y_col: str = "y", cost: float = 1.0, exact: float = 1e-9, steps: int = 100) -> Newton:
    """BLA-1: the weights that minimise half their squared norm plus ``cost`` times the logistic losses, by
    Newton steps within a trust region.

    Each step solves the quadratic model by conjugate gradients; a product of the Hessian with a vector is a
    sum over the rows, so it is a pass of Spark over them that never forms the Hessian. What comes to the
    driver has the size of the weights. It ends when the gradient's norm is at most ``exact`` times that at
    zero (or after ``steps``). Rows with a null, or a null among the features, take no part; without rows
    the model has no weights. Feature arrays of different sizes are an error, and one of a NaN or an infinity too.
    """
    x = F.col(f"`{x_col}`").cast("array<double>")
    ready = rows.select(x.alias("x"), F.col(f"`{y_col}`").cast("int").alias("y")).where("x is not null and y is not null and not exists(x, v -> v is null)")
    ready = checkpointed(ready)
    seen = ready.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"), F.max(F.exists("x", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))).alias("odd")).first()
    if seen["most"] is None:
        return Newton(np.zeros(0), [])
    if seen["least"] != seen["most"] or seen["odd"]:
        raise ValueError("features have to be finite and of one size")

    def losses(w: np.ndarray) -> tuple[float, np.ndarray]:
        def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = y * (x @ w)
            pull = -y / (1 + np.exp(np.minimum(z, 700)))
            return np.concatenate(([np.logaddexp(0, -z).sum()], x.T @ pull))

        total = _summed(ready, part)
        return 0.5 * w @ w + cost * total[0], w + cost * total[1:]

    def curved(w: np.ndarray, v: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            p = 1 / (1 + np.exp(np.clip(-(x @ w), -700, 700)))
            return x.T @ (p * (1 - p) * (x @ v))

        return v + cost * _summed(ready, part)

    w = np.zeros(seen["most"] + 1)
    loss, slope = losses(w)
    first = np.linalg.norm(slope)
    radius, path = first, [loss]
    for _ in range(steps):
        size = np.linalg.norm(slope)
        if size <= exact * first:
            break
        step, rest, edge = _within(lambda v: curved(w, v), slope, radius, min(0.1, size / first) * size)
        promised = -(slope @ step + 0.5 * step @ (-slope - rest))
        new_loss, new_slope = losses(w + step)
        gained = (loss - new_loss) / promised if promised > 0 else 0.0
        # Where the promise is below the loss's rounding, the shorter gradient decides.
        good = gained > 1e-4 or (promised <= 1e-12 * abs(loss) and np.linalg.norm(new_slope) < size)
        if good:
            w, loss, slope = w + step, new_loss, new_slope
            path.append(loss)
            radius = max(radius, 2 * np.linalg.norm(step)) if gained > 0.75 and edge else radius
        else:
            radius = 0.25 * min(radius, np.linalg.norm(step))
            if radius <= 1e-15 * max(1.0, np.linalg.norm(w)):
                break
    return Newton(w, path)


def _within(times: Callable[[np.ndarray], np.ndarray], slope: np.ndarray, radius: float, enough: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """Conjugate gradients for the step, up to a sphere: the step, what is left of the equations, and
    whether the sphere stopped it."""
    step, rest = np.zeros_like(slope), -slope
    way = rest.copy()
    left = rest @ rest
    for _ in range(2 * len(slope)):
        if np.sqrt(left) <= enough:
            break
        bent = times(way)
        far = left / (way @ bent)
        if np.linalg.norm(step + far * way) >= radius:
            a, b, c = way @ way, 2 * (step @ way), step @ step - radius * radius
            far = (-b + np.sqrt(b * b - 4 * a * c)) / (2 * a)
            return step + far * way, rest - far * bent, True
        step, rest = step + far * way, rest - far * bent
        again = rest @ rest
        way, left = rest + again / left * way, again
    return step, rest, False
