"""Linear models from sufficient statistics, and what is made of their scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import classify
from gridlake.operators import ordered


def features_of(rows: DataFrame, columns: list[str], target: str, weight: str | None = None) -> DataFrame:
    """x (array of features), y and w (1 without a column of weights), of rows that have them all as known numbers."""
    y, w = F.col(target), F.lit(1.0) if weight is None else F.col(weight)
    found = rows.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"))
    return known_rows(found)


def known_rows(rows: DataFrame) -> DataFrame:
    every = F.forall("x", lambda v: classify.known(v))
    return rows.where(every & classify.known(F.col("y")) & classify.known(F.col("w")))


@dataclass(frozen=True)
class Moments:
    """Weighted sums of products of (1, features, target), rows of a group."""

    n: int
    gram: np.ndarray

    @property
    def total(self) -> float:
        return float(self.gram[0, 0])

    def error(self, intercept: float, weights: np.ndarray) -> float:
        """Root of the weighted mean of squared errors of a linear model, without another pass."""
        c = np.concatenate([[-intercept], -weights, [1.0]])
        return float(np.sqrt(max(c @ self.gram @ c, 0.0) / self.total))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of a partition, by group: one row a group (group, n, gram)."""
    held: dict[str | None, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        z = np.column_stack([np.ones(len(x)), x, batch.column("y").to_numpy(zero_copy_only=False)])
        w, groups = batch.column("w").to_numpy(zero_copy_only=False), np.array(batch.column("group").to_pylist(), object)
        for group in set(groups.tolist()):
            at = groups == group
            state = held.setdefault(group, [0, 0.0])
            state[0] += int(at.sum())
            state[1] = state[1] + (z[at] * w[at][:, None]).T @ z[at]
    for group, (n, gram) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([group], pa.string()), pa.array([n], pa.int64()), pa.array([gram.ravel().tolist()], pa.list_(pa.float64()))], ["group", "n", "gram"])


def moments(rows: DataFrame, group: Column) -> dict[str, Moments]:
    """Moments by group of rows (x, y, w), in one pass; only sums of products leave the executors, summed there by entry."""
    partial = rows.select(group.cast("string").alias("group"), "x", "y", "w").mapInArrow(_partial, "group string, n long, gram array<double>")
    entries = partial.select("group", "n", F.posexplode("gram").alias("i", "v")).groupBy("group", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    found: dict[str, dict[int, tuple]] = {}
    for r in entries.collect():  # (features + 2) ** 2 rows a group
        found.setdefault(r["group"], {})[r["i"]] = (r["v"], r["n"])
    out = {}
    for name, cells in found.items():
        size = round(len(cells) ** 0.5)
        out[name] = Moments(cells[0][1], np.array([cells[i][0] for i in range(len(cells))]).reshape(size, size))
    return out


def scaler(m: Moments) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations of the features (1 where a feature is constant)."""
    mean = m.gram[0, 1:-1] / m.total
    variance = np.diag(m.gram)[1:-1] / m.total - mean**2
    return mean, np.where(variance > 1e-12 * np.maximum(1, mean**2), np.sqrt(np.maximum(variance, 0)), 1.0)


def ridge(m: Moments, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and coefficients, on the features as given, of a ridge fit to standardised features (penalty alpha, none
    on the intercept)."""
    mean, deviation = scaler(m)
    y_mean = m.gram[0, -1] / m.total
    covariance = (m.gram[1:-1, 1:-1] - m.total * np.outer(mean, mean)) / np.outer(deviation, deviation)
    with_y = (m.gram[1:-1, -1] - m.total * mean * y_mean) / deviation
    weights = np.linalg.solve(covariance + alpha * np.eye(len(mean)), with_y) / deviation
    return float(y_mean - weights @ mean), weights


def select_ridge(train: Moments, validation: Moments, alphas: list[float]) -> list[dict]:
    """A row for each alpha, with its fit and errors; selected: the smallest error on validation, then the smaller alpha."""
    rows = []
    for alpha in sorted(alphas):
        intercept, weights = ridge(train, alpha)
        rows.append({"alpha": float(alpha), "intercept": intercept, "weights": weights, "train_rmse": train.error(intercept, weights), "validation_rmse": validation.error(intercept, weights)})
    best = min(rows, key=lambda r: (r["validation_rmse"], r["alpha"]))
    return [r | {"selected": r is best} for r in rows]


def linear_score(x: Column, intercept: float, weights) -> Column:
    """intercept + weights . x over an array column, evaluated without user functions; null where a feature is not known."""
    products = F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a.cast("double") * b)
    total = F.aggregate(products, F.lit(float(intercept)), lambda s, v: s + v)
    return F.when(F.forall(x, classify.known), total)


def principal_axes(m: Moments, k: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(means, deviations, axes, shares of variance) of standardised features; of an axis the largest entry is positive."""
    mean, deviation = scaler(m)
    covariance = (m.gram[1:-1, 1:-1] / m.total - np.outer(mean, mean)) / np.outer(deviation, deviation)
    values, vectors = np.linalg.eigh(covariance)
    axes = vectors[:, ::-1][:, :k].T
    axes = axes * np.sign(axes[np.arange(k), np.abs(axes).argmax(axis=1)])[:, None]
    return mean, deviation, axes, values[::-1][:k] / values.sum()


def logistic(rows: DataFrame, c: float, balanced: bool = True) -> tuple[float, np.ndarray]:
    """Intercept and coefficients, on the features as given, of a logistic fit to standardised features of rows (x, y, w).

    balanced: both classes weigh the same. c: inverse strength of the penalty, against the sum of the rows' losses.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(counts) != {0.0, 1.0}:
        raise ValueError("both classes are needed")
    n = sum(counts.values())
    mean, deviation = scaler(moments(rows.withColumn("w", F.lit(1.0)), F.lit("all"))["all"])
    scaled = F.zip_with(F.zip_with("x", F.array(*[F.lit(float(v)) for v in mean]), lambda a, b: a - b), F.array(*[F.lit(float(v)) for v in deviation]), lambda a, b: a / b)
    weight = F.when(F.col("y") == 1, n / (2 * counts[1.0])).otherwise(n / (2 * counts[0.0])) if balanced else F.lit(1.0)
    data = rows.select(array_to_vector(scaled).alias("features"), F.col("y").alias("label"), weight.alias("weight"))
    fitted = LogisticRegression(regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, weightCol="weight", maxIter=200, tol=1e-8).fit(data)
    weights = fitted.coefficients.toArray() / deviation
    return float(fitted.intercept - weights @ mean), weights


def select_logistic(train: DataFrame, validation: DataFrame, cs: list[float]) -> list[dict]:
    """A row for each c; selected: the largest average precision on validation, then AUROC, then the larger c."""
    out = []
    for c in cs:
        intercept, weights = logistic(train, c)
        scored = validation.select(F.col("y") == 1, (1 / (1 + F.exp(-linear_score(F.col("x"), intercept, weights)))).alias("p")).toDF("y", "p")
        found = ordered.areas(scored, [], F.col("y"), "p").first()
        out.append({"c": float(c), "intercept": intercept, "weights": weights, "average_precision": found["average_precision"], "auroc": found["auroc"]})
    best = max(out, key=lambda r: (r["average_precision"] or -1, r["auroc"] or -1, r["c"]))
    return [r | {"selected": r is best} for r in out]


def fit_platt(rows: DataFrame, score: str, observed: Column, c: float = 1e6) -> tuple[float, float]:
    """(slope, intercept) of the logistic in the logit of score, nearly without penalty; rows: those of validation only."""
    from gridlake.operators.binary import logit

    given = known_rows(rows.select(F.array(logit(F.col(score))).alias("x"), observed.cast("double").alias("y"), F.lit(1.0).alias("w")))
    intercept, weights = logistic(given, c, balanced=False)
    return float(weights[0]), intercept


def hurdle(rows: DataFrame, p: Column, amount: Column, threshold: float) -> DataFrame:
    """Each row by two policies (policy, predicted): the expected value p * amount, and amount where p reaches the threshold.

    amount is clipped to [0, 1]; without a known p or amount the prediction is null.
    """
    known = classify.known(p) & classify.known(amount)
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), amount))
    both = F.array(F.struct(F.lit("expected_value").alias("policy"), F.when(known, p * clipped).alias("predicted")), F.struct(F.lit("hard_gate").alias("policy"), F.when(known, F.when(p >= threshold, clipped).otherwise(0.0)).alias("predicted")))
    return rows.withColumn("_h", F.explode(both)).select("*", F.col("_h.policy").alias("policy"), F.col("_h.predicted").alias("composed")).drop("_h")
