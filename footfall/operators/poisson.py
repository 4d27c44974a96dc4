"""Poisson regression with a log link, aliased columns dropped first (M6-M8)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import col
from .reuse import held
from .tall_skinny import independent, least_squares, triangle_of

INTERCEPT = "(Intercept)"


def gram_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """``X'X`` of the columns with a leading column of ones.

    Each task adds up its own rows; only p x p sums per task are shuffled, and p x p numbers reach the driver.
    """
    size = len(columns) + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            x = np.column_stack([np.ones(len(x)), x])[~np.isnan(x).any(axis=1)]
            total += x.T @ x
        i, j = np.indices((size, size))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    cells = (
        df.select(*[col(c).cast("double").alias(c) for c in columns])
        .mapInPandas(partial, "i INT, j INT, s DOUBLE")
        .groupBy("i", "j")
        .agg(F.sum("s").alias("s"))
        .collect()
    )
    out = np.zeros((size, size))
    for i, j, s in cells:
        out[i, j] = s
    return out


@dataclass(frozen=True)
class PoissonModel:
    """Fitted coefficients; an aliased feature has none and adds nothing to a prediction."""

    features: tuple[str, ...]
    intercept: float
    coefficients: dict[str, float]
    aliased: tuple[str, ...]
    std_errors: dict[str, float]
    p_values: dict[str, float]
    deviance: float
    null_deviance: float
    aic: float
    iterations: int
    converged: bool = True

    def response(self) -> Column:
        """Expected count of a row: the exponential of the linear predictor."""
        terms = [F.lit(self.intercept)] + [col(f).cast("double") * F.lit(b) for f, b in self.coefficients.items()]
        return F.exp(reduce(add, terms))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per term: estimate, standard error, z and p value; NULLs for an aliased term (M7)."""
        estimates = {INTERCEPT: self.intercept, **self.coefficients}
        rows = []
        for term in [INTERCEPT, *self.features]:
            b, se = estimates.get(term), self.std_errors.get(term)
            z = b / se if b is not None and se else None
            rows.append((term, b, se, z, self.p_values.get(term), term in self.aliased))
        schema = "term STRING, estimate DOUBLE, std_error DOUBLE, z_value DOUBLE, p_value DOUBLE, aliased BOOLEAN"
        stats = {"deviance": self.deviance, "null_deviance": self.null_deviance, "aic": self.aic}
        return spark.createDataFrame(rows, schema).withColumns({k: F.lit(v) for k, v in stats.items()})


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers: Stirling's series, moved up by eight."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    moved = np.log(np.prod([x + i for i in range(8)], axis=0))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - moved


def weighted_lines(x: np.ndarray, beta: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the weighted matrix of one step, and its totals, from rows of label and features.

    The last column is the working response. Totals: rows, sum of labels, of y log y, deviance, and log likelihood. Without
    coefficients the step starts at expected counts next to the labels.
    """
    y, x = x[:, 0], np.column_stack([np.ones(len(x)), x[:, 1:]])
    eta = np.log(y + 0.1) if beta is None else np.clip(x @ beta, -700.0, 700.0)
    mean = np.exp(eta)
    root = np.sqrt(mean)
    own = np.where(y > 0, y * np.log(np.where(y > 0, y, 1.0)), 0.0)
    deviance = 2 * (own - y * eta - (y - mean))
    likelihood = y * eta - mean - log_gamma(y + 1.0)
    totals = np.array([len(y), y.sum(), own.sum(), deviance.sum(), likelihood.sum()])
    return np.column_stack([x, eta + (y - mean) / mean]) * root[:, None], totals


def fit_poisson(frame: DataFrame, label: str, features: Sequence[str], max_iter: int = 50, tol: float = 1e-10
                ) -> PoissonModel:
    """Fit ``label ~ features`` with iteratively reweighted least squares on the cluster.

    Each step is one pass over the rows: tasks fold their weighted rows into a triangle (``tall_skinny``), from which the driver
    takes coefficients and, at the end, standard errors. As no cross products are formed, nearly collinear features keep
    about half of the digits more than normal equations would leave them. Features that are combinations of earlier
    ones are aliased. A step that raises the deviance is halved. Rows with a NULL are left out; negative labels are an error.
    """
    features = list(features)
    numbers = frame.select(*[col(c).cast("double").alias(c) for c in [label, *features]])
    with held(numbers) as rows:
        # Filtered after it is held: a NULL test over dozens of cast columns makes constraint inference explode.
        data = rows.dropna()

        def step(used: Sequence[str], beta: np.ndarray | None):
            return triangle_of(data.select(col(label), *[col(f) for f in used]), lambda x: weighted_lines(x, beta))

        first = step(features, None)
        if first is None:
            raise ValueError("no complete row to fit")
        kept = [j for j in independent(first[0][:, :-1]) if j > 0]
        used = [features[j - 1] for j in kept]
        n, total, own, _, _ = first[1]
        if not np.isfinite(first[1]).all() or total <= 0:
            raise ValueError("labels must be counts, some of them above zero")
        beta, _ = least_squares(first[0][:, [0, *kept, -1]])
        before, deviance, converged = None, math.inf, False
        for iterations in range(1, max_iter + 1):
            triangle, (_, _, _, now, likelihood) = step(used, beta)
            if before is not None and not now <= deviance + tol * (abs(deviance) + 0.1):
                beta = (before + beta) / 2
                continue
            converged = abs(deviance - now) <= tol * (abs(now) + 0.1)
            deviance, after = now, least_squares(triangle)
            if converged:
                break
            before, beta = beta, after[0]
        errors = np.sqrt(np.diag(after[1]))
        if not converged:
            beta = before
    estimates = dict(zip([INTERCEPT, *used], beta.tolist(), strict=True))
    std_errors = dict(zip([INTERCEPT, *used], errors.tolist(), strict=True))
    return PoissonModel(
        features=tuple(features),
        intercept=estimates.pop(INTERCEPT),
        coefficients=estimates,
        aliased=tuple(f for f in features if f not in used),
        std_errors=std_errors,
        p_values={t: math.erfc(abs({INTERCEPT: float(beta[0]), **estimates}[t] / e) / math.sqrt(2)) for t, e in std_errors.items()},
        deviance=float(deviance),
        null_deviance=float(2 * (own - total * math.log(total / n))),
        aic=float(-2 * likelihood + 2 * len(beta)),
        iterations=iterations,
        converged=converged,
    )
