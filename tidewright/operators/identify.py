"""Identification: least squares by Gauss-Newton, with each round's variants evaluated as scenarios of one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Central differences step each parameter by this share of it, and by at least it.
RELATIVE_STEP = 1e-6


def golden_section(f: Callable[[float], float], low: float = 0.0, high: float = 1.0, rounds: int = 40) -> float:
    """Where f is least between low and high, if it has one valley there."""
    ratio = (5**0.5 - 1) / 2
    a, b = low, high
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(rounds):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = f(d)
    return (a + b) / 2


def halving(f: Callable[[float], float], start: float = 1.0, rounds: int = 20) -> float:
    """The first of start, start / 2, ... that lessens f(0); 0 if none does."""
    base, x = f(0.0), start
    for _ in range(rounds):
        if f(x) < base:
            return x
        x /= 2
    return 0.0


@dataclass
class Products:
    """Inner products of the residuals of several parameter vectors, each with each."""

    matrix: np.ndarray

    @classmethod
    def of(cls, residuals: list[np.ndarray] | Products) -> Products:
        if isinstance(residuals, cls):
            return residuals
        rows = np.stack([np.asarray(r, float) for r in residuals])
        return cls(rows @ rows.T)

    @classmethod
    def summed(cls, rows: DataFrame, n: int) -> Products:
        """Of rows(scenario, key, r) for scenarios 0 to n - 1: rows of a key meet, and only sums of products reach the driver."""
        by_key = rows.groupBy("key").agg(*[F.max(F.when(F.col("scenario") == i, F.col("r"))).alias(f"r{i}") for i in range(n)])
        sums = by_key.agg(*[F.coalesce(F.sum(F.col(f"r{i}") * F.col(f"r{j}")), F.lit(0.0)).alias(f"s{i}_{j}") for i in range(n) for j in range(i, n)]).first()
        return cls(np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]))


def gauss_newton(
    residuals: Callable[[list[np.ndarray]], list[np.ndarray] | Products], start: np.ndarray, bounds: tuple[np.ndarray, np.ndarray] | None = None, rounds: int = 30, tolerance: float = 1e-8
) -> tuple[np.ndarray, list[float], str]:
    """(parameters, sum of squares by round, outcome) of the least sum of squared residuals.

    residuals takes many parameter vectors at once, so that a distributed
    evaluation sees a Jacobian's columns as scenarios of one job, and gives
    their residuals, or only the Products of them, which is all that a step
    needs. Steps are cut to the bounds and shortened until they lessen the sum.
    """
    x, history = np.array(start, float), []
    shares = [1.0, 0.5, 0.25, 0.1, 0.02]
    for _ in range(rounds):
        h = RELATIVE_STEP * np.maximum(1.0, np.abs(x))
        trial = [x] + [x + s * h[i] * np.eye(len(x))[i] for i in range(len(x)) for s in (1, -1)]
        found = residuals(trial)
        if isinstance(found, Products):
            slopes = np.zeros((len(x), len(trial)))
            for i in range(len(x)):
                slopes[i, 1 + 2 * i], slopes[i, 2 + 2 * i] = 1 / (2 * h[i]), -1 / (2 * h[i])
            normal, toward, now = slopes @ found.matrix @ slopes.T, slopes @ found.matrix[:, 0], float(found.matrix[0, 0])
            step = np.linalg.lstsq(normal, -toward, rcond=None)[0]
        else:
            jacobian = np.stack([(found[1 + 2 * i] - found[2 + 2 * i]) / (2 * h[i]) for i in range(len(x))], 1)
            step, now = np.linalg.lstsq(jacobian, -found[0], rcond=None)[0], float(found[0] @ found[0])
        history.append(now)
        ways = [x + s * step for s in shares]
        if bounds is not None:
            ways = [np.clip(w, *bounds) for w in ways]
        sums = np.diag(Products.of(residuals(ways)).matrix)
        best = int(np.argmin(sums))
        if not sums[best] < history[-1]:
            return x, history, "no step lessens the sum" if np.abs(step).max() > tolerance else "converged"
        moved = np.abs(ways[best] - x) / np.maximum(1.0, np.abs(x))
        x = ways[best]
        if moved.max() < tolerance:
            history.append(float(sums[best]))
            return x, history, "converged"
    return x, history, "out of rounds"


def factor_residuals(run: Callable[[DataFrame], DataFrame], measured: DataFrame, places: list) -> Callable[[list[np.ndarray]], Products]:
    """residuals for gauss_newton: run takes factors(scenario, place, factor) and gives computed(scenario, key, value), compared with measured(key, value)."""
    spark = measured.sparkSession

    def residuals(vectors: list[np.ndarray]) -> Products:
        rows = [(i, p, float(v)) for i, x in enumerate(vectors) for p, v in zip(places, x, strict=True)]
        kind = "long" if all(isinstance(p, int) for p in places) else "string"
        computed = run(spark.createDataFrame(rows, f"scenario int, place {kind}, factor double"))
        joined = computed.join(measured.withColumnRenamed("value", "seen"), "key").select("scenario", "key", (F.col("value") - F.col("seen")).alias("r"))
        return Products.summed(joined, len(vectors))

    return residuals


def rosenbrock(x: np.ndarray) -> np.ndarray:
    """Residuals whose sum of squares has its least value at ones."""
    return np.array([10 * (x[1] - x[0] ** 2), 1 - x[0]])


def converged_share(scores: DataFrame, good: list[int] = (3, 4, 5)) -> DataFrame:
    """Per cent of solver outcomes that count as converged, and the part of each score."""
    total = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    sums = total.agg(F.sum("n").alias("all"))
    return total.join(F.broadcast(sums)).select("score", (100 * F.col("n") / F.col("all")).alias("per_cent"), F.col("score").isin(list(good)).alias("is_converged"))  # one row
