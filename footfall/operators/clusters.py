"""Standardising, k-means with restarts, nearest centroid and silhouettes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, and_
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import col, quoted
from .fold import fold
from .frames import with_row
from .reuse import held


def scale_parameters(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row with ``center_<f>`` and ``scale_<f>`` (mean, sample standard deviation) per feature."""
    return df.agg(
        *[F.avg(col(f)).alias(f"center_{f}") for f in features],
        *[F.stddev_samp(col(f)).alias(f"scale_{f}") for f in features],
    )


def z_scores(df: DataFrame, parameters: DataFrame, columns: Mapping[str, str], prefix: str = "sc_") -> DataFrame:
    """``(x - center) / scale`` with the stored parameters of another table.

    ``columns`` maps a column of ``df`` to the feature whose parameters it takes.
    """
    needed = [f"{kind}_{f}" for f in columns.values() for kind in ("center", "scale")]
    joined = with_row(df, parameters.select(*needed))
    scored = {
        f"{prefix}{c}": F.try_divide(col(c) - col(f"center_{f}"), col(f"scale_{f}")) for c, f in columns.items()
    }
    return joined.withColumns(scored).drop(*needed)


def nearest(columns: Sequence[str | Column], centroids: Mapping[int, Sequence[float]]) -> Column:
    """Label of the nearest centroid by squared distance, the lowest label on a tie, NULL when a feature is NULL.

    The k fitted centroids are constants of the plan, so this is one generated expression per row and no join.
    """
    cs = [col(c) for c in columns]

    def squared(point: Sequence[float]) -> Column:
        return reduce(add, [(c - F.lit(float(v))) * (c - F.lit(float(v))) for c, v in zip(cs, point, strict=True)])

    ranked = [
        F.struct(squared(p).alias("d"), F.lit(int(label)).alias("label")) for label, p in sorted(centroids.items())
    ]
    best = F.least(*ranked) if len(ranked) > 1 else ranked[0]
    return F.when(reduce(and_, [c.isNotNull() for c in cs]), best["label"])


@dataclass(frozen=True)
class ClusterModel:
    """Fitted k-means: scaling parameters and centroids in scaled units, labelled 1..k in a stable order."""

    features: tuple[str, ...]
    centers: dict[str, float]
    scales: dict[str, float]
    centroids: dict[int, tuple[float, ...]]
    cost: float
    seed_costs: dict[int, float]

    def scaled(self, columns: Mapping[str, str] | None = None) -> list[Column]:
        """Scaled features as Columns; ``columns`` renames a feature to the column that carries it elsewhere."""
        names = columns or {}
        return [
            (col(names.get(f, f)) - F.lit(self.centers[f])) / F.lit(self.scales[f]) for f in self.features
        ]

    def label(self) -> Column:
        return nearest(self.scaled(), self.centroids)

    def label_on(self, columns: Mapping[str, str]) -> Column:
        """Assignment by the named subset of features, each matched to its own centroid coordinate (M4)."""
        chosen = [(i, f) for i, f in enumerate(self.features) if f in columns]
        xs = [(col(columns[f]) - F.lit(self.centers[f])) / F.lit(self.scales[f]) for _, f in chosen]
        return nearest(xs, {c: [p[i] for i, _ in chosen] for c, p in self.centroids.items()})


def weighted_points(df: DataFrame, features: Sequence[str], weight: str = "weight") -> DataFrame:
    """Equal feature vectors merged into one row with a weight; rows with a NULL feature are left out."""
    return df.select(*[col(f).cast("double").alias(f) for f in features]).dropna().groupBy(*features).agg(
        F.count(F.lit(1)).cast("double").alias(weight)
    )


def _weighted_scaling(points: DataFrame, features: Sequence[str], weight: str):
    w = col(weight)
    n, *sums = points.agg(F.sum(w), *[F.sum(w * col(f)) for f in features]).first()
    if not n:
        raise ValueError("no complete row to cluster")
    centers = {f: s / n for f, s in zip(features, sums)}
    squares = points.agg(*[F.sum(w * F.pow(col(f) - F.lit(centers[f]), 2)) for f in features]).first()
    scales = {f: (s / (n - 1)) ** 0.5 if n > 1 and s > 0 else 1.0 for f, s in zip(features, squares)}
    return centers, scales


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def first_by_hash(points: DataFrame, features: Sequence[str], k: int, seeds: Sequence[int]) -> np.ndarray:
    """For each seed the k distinct points of smallest hash of seed and features: starts of restarts, in one pass."""
    def of(x: np.ndarray, seed: int) -> np.ndarray:
        h = np.full(len(x), seed & 0xFFFFFFFF, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for column in (x + 0.0).T:  # -0.0 is 0.0
            h = _mixed(h + np.ascontiguousarray(column).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return h

    def least(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for h, x in pairs:
            at = np.lexsort([*x.T[::-1], h])[:k]
            out.append((h[at], x[at]))
        return out

    def add(state, x):
        found = least([(of(x, s), x) for s in seeds])
        return found if state is None else merge(state, found)

    def merge(a, b):
        return least([(np.concatenate([h, g]), np.vstack([x, y])) for (h, x), (g, y) in zip(a, b, strict=True)])

    found = fold(points.select(*[col(f) for f in features]), add, merge)
    if found is None or len(found[0][0]) < k:
        raise ValueError(f"fewer than {k} distinct points")
    return np.stack([x for _, x in found])


class _Step(NamedTuple):
    """What a pass sums up for each restart: weight and weighted sums by cluster, cost at the old centroids, changes of the
    sums if all points moved that gain by it, and the one move that gains most (gain, change of the sums)."""

    sums: np.ndarray
    cost: np.ndarray
    moves: np.ndarray
    gain: np.ndarray
    best: np.ndarray


def _step(points: DataFrame, centroids: np.ndarray, sizes: np.ndarray) -> _Step:
    """One pass for all restarts. ``points`` has the features and then the weight; ``sizes`` are weights of the clusters.

    Taking a point of weight w and distance d from its cluster saves n w / (n - w) d^2, adding it to another costs
    n w / (n + w) d^2: the centroids move with it. It gains by moving where the second is smaller.
    """
    def add(state: _Step | None, rows: np.ndarray) -> _Step:
        x, w = rows[:, :-1], rows[:, -1]
        lines = np.column_stack([w, w[:, None] * x])
        r, k, p = centroids.shape
        out = _Step(*(np.zeros(s) for s in ((r, k, p + 1), r, (r, k, p + 1), r, (r, k, p + 1))))
        for i in range(r):
            d2 = ((x[:, None, :] - centroids[i]) ** 2).sum(axis=2)
            own = d2.argmin(axis=1)
            at = np.arange(len(x))
            out.cost[i] = (w * d2[at, own]).sum()
            np.add.at(out.sums[i], own, lines)
            n = sizes[i]
            if not np.isfinite(n).all():
                continue
            left = n[own] - w
            saved = np.where(left > 1e-9 * w, n[own] * w / np.where(left > 0, left, 1.0) * d2[at, own], 0.0)
            cost = n * w[:, None] / np.maximum(n + w[:, None], 1e-300) * d2
            cost[at, own] = np.inf
            to = cost.argmin(axis=1)
            gain = saved - cost[at, to]
            moved = gain > 1e-12 * (1 + saved)
            np.add.at(out.moves[i], to[moved], lines[moved])
            np.add.at(out.moves[i], own[moved], -lines[moved])
            j = int(gain.argmax())
            if moved[j]:
                out.gain[i] = gain[j]
                out.best[i, to[j]] += lines[j]
                out.best[i, own[j]] -= lines[j]
        return out if state is None else merge(state, out)

    def merge(a: _Step, b: _Step) -> _Step:
        better = (b.gain > a.gain)[:, None, None]
        return _Step(a.sums + b.sums, a.cost + b.cost, a.moves + b.moves, np.maximum(a.gain, b.gain), np.where(better, b.best, a.best))

    return fold(points, add, merge)


def _explained(sums: np.ndarray) -> float:
    """Sum over clusters of weight times squared centroid; the cost is what this leaves of the squares of all points."""
    n = sums[:, 0]
    return float(((sums[:, 1:] ** 2).sum(axis=1) / np.where(n > 0, n, 1.0))[n > 0].sum())


def descended(
    points: DataFrame, starts: np.ndarray, squares: float, max_iter: int, transfers: bool = True, tol: float = 1e-10
) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and costs of k-means from each start (restarts x clusters x features), one job an iteration for all.

    An iteration assigns every point to its nearest centroid and looks for transfers that gain although no centroid is nearer. Of
    the partition as it is, with all transfers, and with the best one, it goes on with the one of least cost, which the sums
    give exactly. So no iteration ends above the plain one, and at the end no single transfer lowers the cost. ``squares`` is
    the weighted sum of squares of all points.
    """
    centroids = starts.astype(float).copy()
    costs = np.full(len(starts), np.inf)
    sizes = np.full(starts.shape[:2], np.nan)
    open_ = np.arange(len(starts))
    for _ in range(max_iter):
        found = _step(points, centroids[open_], sizes[open_])
        going = []
        for j, i in enumerate(open_):
            choices = [found.sums[j], found.sums[j] + found.moves[j], found.sums[j] + found.best[j]][:3 if transfers else 1]
            choices = [c for c in choices if (c[:, 0] > -1e-9).all()]
            taken = max(choices, key=_explained)
            n = np.where(taken[:, 0] > 1e-9, taken[:, 0], 0.0)
            centroids[i] = np.where(n[:, None] > 0, taken[:, 1:] / np.where(n > 0, n, 1.0)[:, None], centroids[i])
            sizes[i], before = n, costs[i]
            costs[i] = max(0.0, squares - _explained(np.where(n[:, None] > 0, taken, 0.0)))
            if not before - costs[i] <= tol * max(squares, 1e-300):
                going.append(i)
        open_ = np.array(going, int)
        if not len(open_):
            break
    return centroids, costs


def fit_kmeans(
    df: DataFrame,
    features: Sequence[str],
    k: int = 4,
    seeds: Iterable[int] = range(123, 148),
    max_iter: int = 50,
    order_by: Sequence[str] = (),
) -> ClusterModel:
    """k-means on standardised features, the best of one run per seed (M1, M2).

    Equal rows are merged into weighted points, which leaves the objective unchanged. Each seed starts from k points chosen by
    a hash of their features, so starts do not depend on the order or the partitioning of the rows. All runs share one pass
    over the points an iteration (``descended``). Clusters are numbered by their centroid (``order_by`` first), not by chance.
    """
    features, weight, seeds = list(features), "weight", [int(s) for s in seeds]
    with held(weighted_points(df, features, weight)) as points:
        centers, scales = _weighted_scaling(points, features, weight)
        scaled = points.select(
            *[((col(f) - F.lit(centers[f])) / F.lit(scales[f])).alias(f) for f in features], weight
        )
        squares = scaled.agg(F.sum(col(weight) * reduce(add, [col(f) * col(f) for f in features]))).first()[0]
        starts = first_by_hash(scaled, features, k, seeds)
        centroids, runs = descended(scaled, starts, float(squares), max_iter)
    best = int(np.lexsort((seeds, runs))[0])
    found = [tuple(map(float, c)) for c in centroids[best]]
    order = [features.index(f) for f in [*order_by, *[f for f in features if f not in order_by]]]
    found.sort(key=lambda c: tuple(c[i] for i in order))
    return ClusterModel(
        tuple(features), centers, scales, dict(enumerate(found, start=1)), float(runs[best]), dict(zip(seeds, runs.tolist())))


def silhouette_squared(
    df: DataFrame, columns: Sequence[str], cluster: str, labels: Sequence[int], name: str = "silhouette"
) -> DataFrame:
    """Silhouette width of every row under squared Euclidean distance, without any pair of rows (M5 a).

    Per cluster only the count, the sum vector and the sum of squares are needed; they form one aggregate row that
    reaches every row as a constant. Columns are taken from their means, as squares of large values would lose the digits
    in which rows differ. A row alone in its cluster scores 0.
    """
    means = df.agg(*[F.avg(col(c).cast("double")).alias(f"__m{j}") for j, c in enumerate(columns)])
    centred = with_row(df, means)
    xs = [f"(CAST({quoted(c)} AS DOUBLE) - __m{j})" for j, c in enumerate(columns)]
    norm = " + ".join(f"{x} * {x}" for x in xs)
    own = col(cluster)
    terms = []
    for i, label in enumerate(labels):
        here = f"{quoted(cluster)} = {int(label)}"
        terms.append(F.expr(f"CAST(count_if({here}) AS DOUBLE) AS __n{i}"))
        terms += [F.expr(f"sum(CASE WHEN {here} THEN {x} END) AS __s{i}_{j}") for j, x in enumerate(xs)]
        terms.append(F.expr(f"sum(CASE WHEN {here} THEN {norm} END) AS __q{i}"))
    totals = centred.agg(*terms)

    def total_distance(i: int) -> Column:
        """Sum of squared distances from the row to every member of cluster i."""
        dot = " + ".join(f"{x} * __s{i}_{j}" for j, x in enumerate(xs))
        return F.expr(f"greatest(__n{i} * ({norm}) - 2D * ({dot}) + __q{i}, 0D)")

    known = with_row(centred, totals).withColumns({f"__t{i}": total_distance(i) for i in range(len(labels))})
    return _widths(
        known, own, labels, name,
        others_in_own=lambda i: F.col(f"__n{i}") - 1.0,
        members=lambda i: F.col(f"__n{i}"),
    ).select(*[col(c) for c in df.columns], name)


def _widths(df: DataFrame, own: Column, labels: Sequence[int], name: str, others_in_own, members) -> DataFrame:
    """``(b - a) / max(a, b)``: a is the mean distance to the rest of the own cluster, b to the nearest other one.

    ``__t<i>`` holds the distance sum to cluster i. A row alone in its cluster scores 0.
    """
    total = lambda i: F.col(f"__t{i}")
    a = F.coalesce(*[
        F.when(own == label, F.try_divide(total(i), others_in_own(i))) for i, label in enumerate(labels)
    ])
    other = [F.when(own != label, F.try_divide(total(i), members(i))) for i, label in enumerate(labels)]
    b = F.least(*other) if len(other) > 1 else other[0]
    width = F.when(F.col("__a").isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("__b") - F.col("__a"), F.greatest("__a", "__b")), F.lit(0.0))
    )
    known = own.isin(list(labels)) & F.col("__b").isNotNull()
    return df.withColumns({"__a": a, "__b": b}).withColumn(name, F.when(known, width))
