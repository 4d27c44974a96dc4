"""Polynomial trends per series and local regression."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.curves import year_grid
from ..functions.nulls import col
from .groups import lookup


def quadratic_fit(df: DataFrame, series: Sequence[str], x: str, y: str, origin: float) -> DataFrame:
    """Least-squares parabola per series: ``b0 + b1 t + b2 t^2`` with ``t = x - origin``, and R squared.

    One aggregation of power sums, which combines on the map side, then a closed form on one row per series. The sums
    are moved to the mean of t before solving. A series with fewer than three distinct x gives NULL.
    """
    t = (col(x) - F.lit(origin)).cast("double")
    v = col(y).cast("double")
    both = t.isNotNull() & v.isNotNull()
    s = F.col
    sums = df.filter(both).groupBy(*[col(c) for c in series]).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(t).alias("t1"), F.sum(t * t).alias("t2"), F.sum(t * t * t).alias("t3"), F.sum(t * t * t * t).alias("t4"),
        F.sum(v).alias("v1"), F.sum(v * v).alias("v2"), F.sum(t * v).alias("tv"), F.sum(t * t * v).alias("ttv"),
    )
    m = F.col("m")
    centred = sums.withColumn("m", s("t1") / s("n")).withColumns({
        "uu": s("t2") - s("n") * m * m,
        "uuu": s("t3") - 3 * m * s("t2") + 2 * s("n") * m * m * m,
        "u4": s("t4") - 4 * m * s("t3") + 6 * m * m * s("t2") - 3 * s("n") * m * m * m * m,
        "uv": s("tv") - m * s("v1"),
        "uuv": s("ttv") - 2 * m * s("tv") + m * m * s("v1"),
    }).withColumn("c", s("uu") / s("n")).withColumns({
        "ww": s("u4") - s("n") * s("c") * s("c"),
        "wv": s("uuv") - s("c") * s("v1"),
    }).withColumn("det", s("uu") * s("ww") - s("uuu") * s("uuu"))
    det = F.when(F.abs(s("det")) > 1e-9 * s("uu") * s("ww"), s("det"))
    solved = centred.withColumns({
        "bu": F.try_divide(s("uv") * s("ww") - s("wv") * s("uuu"), det),
        "b2": F.try_divide(s("wv") * s("uu") - s("uv") * s("uuu"), det),
    })
    mean = s("v1") / s("n")
    return solved.withColumns({
        "b1": s("bu") - 2 * m * s("b2"),
        "b0": mean - s("bu") * m + s("b2") * (m * m - s("c")),
        "r_squared": F.try_divide(s("bu") * s("uv") + s("b2") * s("wv"), s("v2") - s("n") * mean * mean),
    }).select(*[col(c) for c in series], s("n").cast("bigint").alias("n"), "b0", "b1", "b2", "r_squared")


def quadratic_forecast(fit: DataFrame, first: int, last: int, origin: float, x: str = "year",
                       name: str = "predicted") -> DataFrame:
    """Fitted parabolas over ``first..last``, one row per series and x."""
    grid = fit.withColumn(x, year_grid(first, last))
    t = F.col(x) - F.lit(origin)
    return grid.withColumn(name, F.col("b0") + F.col("b1") * t + F.col("b2") * t * t)


def polynomial_fit(df: DataFrame, series: Sequence[str], x: str, y: str, degree: int) -> DataFrame:
    """Least-squares polynomial of any degree per series on an orthogonal basis, with standard errors.

    The basis follows the three-term recurrence ``p[k+1] = (t - alpha[k]) p[k] - beta[k] p[k-1]`` over the x of the series
    moved to -1..1, and needs only sums of powers, so rows are aggregated on the map side. ``coefficients`` belong to the
    basis of unit length (the first is that of the constant), each with the standard error ``sigma`` of the residuals.
    A series with too few distinct x gives NULL; ``sigma`` is NULL without degrees of freedom.
    """
    series = list(series)
    known = df.select(*[col(c) for c in series], col(x).cast("double").alias("__x"), col(y).cast("double").alias("__y"))
    known = known.filter(F.col("__x").isNotNull() & F.col("__y").isNotNull())
    extent = known.groupBy(*[col(c) for c in series]).agg(
        F.count(F.lit(1)).alias("__n"), ((F.min("__x") + F.max("__x")) / 2).alias("centre"), ((F.max("__x") - F.min("__x")) / 2).alias("half"))
    extent = extent.withColumn("half", F.when(F.col("half") > 0, F.col("half")).otherwise(F.lit(1.0)))
    t = (F.col("__x") - F.col("centre")) / F.col("half")
    power = lambda k: F.pow(t, F.lit(float(k))) if k else F.lit(1.0)
    sums = lookup(known, extent, series, "__n").groupBy(*[col(c) for c in series], "centre", "half").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("__y") * F.col("__y")).alias("__yy"),
        F.array(*[F.sum(power(k)) for k in range(2 * degree + 1)]).alias("__t"),
        F.array(*[F.sum(F.col("__y") * power(k)) for k in range(degree + 1)]).alias("__ty"))

    def solve(t_sums: np.ndarray, y_sums: np.ndarray, n: int, squares: float):
        hankel = t_sums[np.add.outer(np.arange(degree + 1), np.arange(degree + 1))]
        basis, norms, alphas, betas = [np.eye(degree + 1)[0]], [hankel[0, 0]], [], []
        for k in range(degree):
            p = basis[-1]
            shifted = np.concatenate([[0.0], p[:-1]])
            alphas.append(float(shifted @ hankel @ p / norms[-1]))
            betas.append(float(norms[-1] / norms[-2]) if k else 0.0)
            following = shifted - alphas[-1] * p - (betas[-1] * basis[-2] if k else 0.0)
            norms.append(float(following @ hankel @ following))
            if not norms[-1] > 1e-11 * t_sums[2 * k + 2]:
                return None
            basis.append(following)
        products = np.array([p @ y_sums for p in basis])
        length = np.sqrt(norms)
        rest = max(0.0, squares - float((products**2 / norms).sum()))
        spread = squares - float(products[0] ** 2 / norms[0])
        sigma = float(np.sqrt(rest / (n - degree - 1))) if n > degree + 1 else None
        return alphas, betas, (products / norms).tolist(), (products / length).tolist(), sigma, 1 - rest / spread if spread > 0 else None

    def run(batches):
        for batch in batches:
            found = [solve(np.array(a), np.array(b), n, q) for a, b, n, q in zip(batch["__t"], batch["__ty"], batch["n"], batch["__yy"])]
            out = batch[[*series, "centre", "half", "n"]].copy()
            for i, name in enumerate(["alpha", "beta", "monic", "coefficients", "sigma", "r_squared"]):
                out[name] = pd.Series([None if f is None else f[i] for f in found], index=out.index, dtype=object)
            yield out

    lists = ["alpha", "beta", "monic", "coefficients"]
    schema = T.StructType([
        *[sums.schema[c] for c in [*series, "centre", "half", "n"]], *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in lists],
        T.StructField("sigma", T.DoubleType()), T.StructField("r_squared", T.DoubleType())])
    return sums.mapInPandas(run, schema)


def polynomial_forecast(fit: DataFrame, first: int, last: int, degree: int, x: str = "year", name: str = "predicted") -> DataFrame:
    """Fitted polynomials over ``first..last``, one row per series and x."""
    grid = fit.withColumn(x, year_grid(first, last))
    t = (F.col(x) - F.col("centre")) / F.col("half")
    before, here = F.lit(0.0), F.lit(1.0)
    total = F.get("monic", F.lit(0))
    for k in range(degree):
        before, here = here, (t - F.get("alpha", F.lit(k))) * here - F.get("beta", F.lit(k)) * before
        total = total + F.get("monic", F.lit(k + 1)) * here
    return grid.withColumn(name, total)


def loess(df: DataFrame, series: Sequence[str], x: str, y: str, span: float = 0.75, degree: int = 2,
          grid: int | None = None, name: str = "smoothed") -> DataFrame:
    """Local weighted polynomial of each series at its own x, or at ``grid`` even points of its range.

    Tricube weights over the ``floor(span * n)`` nearest points; the degree drops when too few points carry weight. The
    input is an aggregated series (one row per period), so a group holds at most the periods of the calendar covered.
    """
    series = list(series)

    # Both helpers are nested so that they travel to the executors with the job.
    def local_fit(xs: np.ndarray, ys: np.ndarray, at: float, k: int) -> float:
        gap = np.abs(xs - at)
        reach = np.sort(gap)[k - 1] * max(1.0, span)
        weight = np.clip(1.0 - (gap / reach) ** 3, 0.0, None) ** 3 if reach > 0 else (gap == 0).astype(float)
        near = weight > 0
        if not near.any():
            return float("nan")
        power = min(degree, len(np.unique(xs[near])) - 1)
        root = np.sqrt(weight[near])
        basis = np.vander(xs[near] - at, power + 1, increasing=True)
        return float(np.linalg.lstsq(basis * root[:, None], ys[near] * root, rcond=None)[0][0])

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["x", "y"]).sort_values("x")
        xs, ys = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        if len(xs) == 0:
            return pd.DataFrame({**{c: [] for c in series}, "x": [], name: []})
        k = max(1, min(len(xs), int(np.floor(span * len(xs) + 1e-5))))
        points = xs if grid is None else np.linspace(xs[0], xs[-1], grid)
        out = pd.DataFrame({"x": points, name: [local_fit(xs, ys, p, k) for p in points]})
        for c in series:
            out[c] = pdf[c].iloc[0]
        return out[[*series, "x", name]]

    schema = T.StructType(
        [df.schema[c] for c in series] + [T.StructField("x", T.DoubleType()), T.StructField(name, T.DoubleType())]
    )
    points = df.select(*[col(c) for c in series], col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))
    return points.groupBy(*[col(c) for c in series]).applyInPandas(smooth, schema)
