"""Silhouette widths under Euclidean distance with certified bounds (M5 b, J10).

The width of a row needs its mean distance to each cluster. For a cell of points with weight W, centre m and mean squared
deviation v, the sum of distances from x lies between W |x - m| and W sqrt(|x - m|^2 + v): both follow from convexity, so
they hold whatever the points are. Cells form a tree; a cell is opened only where the two ends are further apart than the
tolerance allows.

* Equal rows of a cluster are one weighted point, so copies cost nothing.
* The tree over the whole table has a bounded number of cells (``LEAVES`` a cluster). It is cut from a bounded sample, but its moments
  are taken over all points, and only they enter the bounds. It is sent to all tasks, which walk it for their points.
* What a point still needs of a leaf goes to a join on the leaf. Points of a leaf and the points that ask for it are dealt
  into blocks, so no task gets a whole leaf; a task cuts a tree of its own from its block and walks it down to single points.

With tolerance 0 every pair of distinct points is compared and the width is exact; with a tolerance the number of cells that a
point opens depends on the tolerance and the shape of the data, not on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import col
from .groups import lookup
from .reuse import held

#: Cells of the tree that all tasks get, by cluster at most; points that it is cut from; points of a block; of a last cell.
LEAVES, SAMPLE, BLOCK, FEW = 512, 20_000, 8192, 8


class Cells(NamedTuple):
    """Cells of a tree, the children of cell i at ``child[i]`` and the next place; a cell without children has -1."""

    weight: np.ndarray
    centre: np.ndarray
    spread: np.ndarray  # mean squared deviation from the centre
    child: np.ndarray

    def ends(self, points: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible sum of distances from each point to its cell."""
        d2 = ((points - self.centre[cells]) ** 2).sum(axis=1)
        low = self.weight[cells] * np.sqrt(d2)
        return low, np.where(self.spread[cells] > 0, self.weight[cells] * np.sqrt(d2 + self.spread[cells]), low)


def halves(x: np.ndarray) -> tuple[int, float] | None:
    """A feature and a value that part the points about the middle of the widest feature; None when all are equal."""
    extent = x.max(axis=0) - x.min(axis=0)
    j = int(extent.argmax())
    if not extent[j] > 0:
        return None
    mark = float(np.median(x[:, j]))
    if mark >= x[:, j].max():
        mark = float(x[:, j][x[:, j] < mark].max())
    return j, mark


def grown(x: np.ndarray, weight: np.ndarray, few: int) -> tuple[Cells, list[np.ndarray]]:
    """A tree over the points whose last cells hold ``few`` of them at most, and the points of each cell (empty if parted)."""
    weights, centres, spreads, child, members, todo = [], [], [], [], [], []

    def add(at: np.ndarray) -> int:
        w = weight[at]
        centre = np.average(x[at], axis=0, weights=w)
        weights.append(w.sum())
        centres.append(centre)
        spreads.append(float((w * ((x[at] - centre) ** 2).sum(axis=1)).sum() / w.sum()))
        child.append(-1)
        members.append(at)
        todo.append(len(members) - 1)
        return len(members) - 1

    add(np.arange(len(x)))
    while todo:
        i = todo.pop()
        at = members[i]
        parted = halves(x[at]) if len(at) > few else None
        if parted:
            lower = x[at, parted[0]] <= parted[1]
            members[i] = at[:0]
            child[i] = add(at[lower])
            add(at[~lower])
    return Cells(np.array(weights), np.array(centres), np.array(spreads), np.array(child)), members


def walked(cells: Cells, points: np.ndarray, share: float, few: int = 65_536) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From the root, for some points at a time: (points, low, high, places and cells that the bounds leave open).

    A cell is closed for a point where its two ends differ by at most ``share`` of the larger one.
    """
    for start in range(0, len(points), few):
        here = np.arange(start, min(start + few, len(points)))
        low, high = np.zeros(len(here)), np.zeros(len(here))
        place, cell, open_ = np.arange(len(here)), np.zeros(len(here), int), []
        while len(place):
            a, b = cells.ends(points[here[place]], cell)
            closed = (b - a) <= share * b
            np.add.at(low, place[closed], a[closed])
            np.add.at(high, place[closed], b[closed])
            place, cell = place[~closed], cell[~closed]
            last = cells.child[cell] < 0
            if last.any():
                open_.append(np.stack([place[last], cell[last]], axis=1))
            place, cell = place[~last], cells.child[cell[~last]]
            place, cell = np.concatenate([place, place]), np.concatenate([cell, cell + 1])
        yield here, low, high, np.concatenate(open_) if open_ else np.zeros((0, 2), int)


def block_sums(x: np.ndarray, weight: np.ndarray, asked: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Bounds of the weighted sums of distances from each asked point to the points ``x``, and the pairs that were opened."""
    cells, members = grown(x, weight, FEW)
    low, high, pairs = np.zeros(len(asked)), np.zeros(len(asked)), 0
    for here, a, b, open_ in walked(cells, asked, share):
        low[here] += a
        high[here] += b
        if not len(open_):
            continue
        order = np.argsort(open_[:, 1], kind="stable")
        places, which = open_[order, 0], open_[order, 1]
        starts = np.flatnonzero(np.diff(which, prepend=-1))
        for i, j in zip(starts, [*starts[1:], len(which)], strict=True):
            at, own = here[places[i:j]], members[which[i]]
            d = np.sqrt(((asked[at][:, None, :] - x[own][None, :, :]) ** 2).sum(axis=2)) @ weight[own]
            low[at] += d
            high[at] += d
            pairs += len(at) * len(own)
    return low, high, pairs


class Cuts(NamedTuple):
    """Where the whole table is parted: feature, value and first child of each cell (-1: a leaf), and number of each leaf."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    leaf: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        at = np.zeros(len(x), int)
        while True:
            inner = np.flatnonzero(self.child[at] >= 0)
            if not len(inner):
                return self.leaf[at]
            i = at[inner]
            at[inner] = self.child[i] + (x[inner, self.feature[i]] > self.value[i])


def cuts_of(sample: np.ndarray, leaves: int) -> Cuts:
    """Cuts along medians of the sample until there are ``leaves`` cells, those with most points first."""
    feature, value, child, members = [0], [0.0], [-1], [np.arange(len(sample))]
    closed = 0
    while len(members) < 2 * leaves - 1:
        sizes = [len(m) if c < 0 else 0 for m, c in zip(members, child, strict=True)]
        i = int(np.argmax(sizes))
        if sizes[i] < 2:
            break
        parted = halves(sample[members[i]])
        if not parted:
            members[i] = members[i][:1]
            closed += 1
            continue
        lower = sample[members[i], parted[0]] <= parted[1]
        feature[i], value[i], child[i] = *parted, len(members)
        members += [members[i][lower], members[i][~lower]]
        feature, value, child = [*feature, 0, 0], [*value, 0.0, 0.0], [*child, -1, -1]
    child_ = np.array(child)
    leaf = np.cumsum(child_ < 0) - 1
    return Cuts(np.array(feature), np.array(value), child_, leaf)


def trees(cuts: Cuts, moments: Sequence[tuple], labels: Sequence, size: int) -> list[Cells]:
    """For each cluster the tree with its moments, from (cluster, leaf, weight, mean and mean square of its points)."""
    w = np.zeros((len(labels), len(cuts.child)))
    mean, m2 = np.zeros((*w.shape, size)), np.zeros(w.shape)
    cell_of = np.flatnonzero(cuts.child < 0)  # leaves are numbered in order
    for label, leaf, weight, centre, square in moments:
        at = labels.index(label), cell_of[leaf]
        w[at], mean[at] = weight, centre
        m2[at] = weight * max(0.0, square - np.dot(centre, centre) + 1e-13 * square)  # never below the true value
    for i in range(len(cuts.child) - 1, -1, -1):  # children come after their parent
        c = cuts.child[i]
        if c >= 0:
            w[:, i] = w[:, c] + w[:, c + 1]
            some = np.maximum(w[:, i], 1e-300)
            mean[:, i] = (w[:, c, None] * mean[:, c] + w[:, c + 1, None] * mean[:, c + 1]) / some[:, None]
            apart = ((mean[:, c] - mean[:, c + 1]) ** 2).sum(axis=1)
            m2[:, i] = m2[:, c] + m2[:, c + 1] + w[:, c] * w[:, c + 1] / some * apart
    return [Cells(w[k], mean[k], m2[k] / np.maximum(w[k], 1e-300), cuts.child) for k in range(len(labels))]


def numbers(batch: pa.RecordBatch | pa.Table, names: Sequence[str]) -> np.ndarray:
    """Columns of doubles as lines."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    return np.column_stack([c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy() for c in columns])


def silhouette_euclidean(
    df: DataFrame, columns: Sequence[str], cluster: str, tolerance: float = 0.0, name: str = "silhouette", leaves: int = LEAVES,
    block: int = BLOCK, sample: int = SAMPLE,
) -> DataFrame:
    """Adds ``name`` with its certified ends ``<name>_low`` and ``<name>_high``, at most ``tolerance`` apart, and ``opened``,
    the number of single points that the row was compared with.

    The width is NULL for a row with a NULL feature or cluster, and where there is one cluster only; a row alone in its cluster
    has 0. The number of clusters is that of a clustering, a few.
    """
    xs = [f"__x{j}" for j in range(len(columns))]
    rows = df.withColumns({**{x: col(c).cast("double") for x, c in zip(xs, columns, strict=True)}, "__own": col(cluster).cast("string")})
    complete = rows.select("__own", *xs).dropna()
    middle = complete.agg(*[F.coalesce(F.avg(x), F.lit(0.0)) for x in xs]).first()
    points = complete.groupBy("__own", *xs).agg(F.count(F.lit(1)).alias("__n"))
    with held(points) as points:
        sizes = {r[0]: r[1] for r in points.groupBy("__own").agg(F.sum("__n")).collect()}
        labels = sorted(sizes)
        picked = points.select(*[(F.col(x) - F.lit(m)).alias(x) for x, m in zip(xs, middle, strict=True)])
        picked = picked.orderBy(F.xxhash64(*xs), *xs).limit(sample).collect()
        cuts = cuts_of(np.array([list(r) for r in picked] or [[0.0] * len(xs)]), leaves)
        with held(_placed(points, xs, middle, cuts)) as placed:
            table = _bounded(placed, xs, cuts, labels, tolerance, block)
            with held(_widths(table, xs, sizes, name)) as known:
                out = lookup(rows, known, ["__own", *xs], "__n")
    return out.select(*[col(c) for c in df.columns], f"{name}_low", name, f"{name}_high", "opened")


def _placed(points: DataFrame, xs: list[str], middle: Sequence[float], cuts: Cuts) -> DataFrame:
    """Points moved to the middle of the table, with their leaf; the features as they were stay the key."""
    ys = [f"__y{j}" for j in range(len(xs))]
    moved = points.withColumns({y: F.col(x) - F.lit(m) for y, x, m in zip(ys, xs, middle, strict=True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = cuts.place(numbers(batch, ys)) if batch.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=[*batch.schema.names, "__leaf"])

    kinds = ", ".join([f"{n} {k}" for n, k in moved.dtypes] + ["__leaf int"])
    return moved.mapInArrow(run, kinds)


def _bounded(placed: DataFrame, xs: list[str], cuts: Cuts, labels: list[str], tolerance: float, block: int) -> DataFrame:
    """One row for each point and cluster or part of it: ``__other``, bounds of the sum of distances ``__low``, ``__high``."""
    ys = [f"__y{j}" for j in range(len(xs))]
    share = tolerance / 3  # of two sums; the width is a ratio of them
    square = sum((F.col(y) * F.col(y) for y in ys), F.lit(0.0))
    mean = lambda c: F.sum(F.col("__n") * c) / F.sum("__n")
    moments = placed.groupBy("__own", "__leaf").agg(
        F.sum("__n").cast("double"), F.array(*[mean(F.col(y)) for y in ys]), mean(square), F.count(F.lit(1))).collect()
    forest = trees(cuts, [tuple(m[:5]) for m in moments], labels, len(xs))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = numbers(batch, ys) if batch.num_rows else np.zeros((0, len(ys)))
            for k, cells in enumerate(forest):
                for here, low, high, open_ in walked(cells, lines, share):
                    order = np.argsort(open_[:, 0], kind="stable")
                    leaf = pa.array(cuts.leaf[open_[order, 1]], pa.int32())
                    ends = np.concatenate([[0], np.cumsum(np.bincount(open_[:, 0], minlength=len(here)))])
                    part = batch.slice(here[0], len(here)) if len(here) else batch.slice(0, 0)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array([labels[k]] * len(here), pa.string()), pa.array(low), pa.array(high),
                         pa.ListArray.from_arrays(pa.array(ends, pa.int32()), leaf)],
                        names=[*part.schema.names, "__other", "__low", "__high", "__open"])

    key = ["__own", *xs, "__n"]
    source = placed.select(*key, *ys)
    kinds = ", ".join(f"{n} {k}" for n, k in source.dtypes)
    with held(source.mapInArrow(walk, kinds + ", __other string, __low double, __high double, __open array<int>")) as first:
        asked = first.select(*key, *ys, "__other", F.explode("__open").alias("__leaf"))
        wanted = {(r[0], r[1]): r[2] for r in asked.groupBy("__other", "__leaf").agg(F.count(F.lit(1))).collect()}
        parts = [(m[0], m[1], -(-m[5] // block), -(-wanted[m[0], m[1]] // block)) for m in moments if (m[0], m[1]) in wanted]
        closed = first.select(*key, "__other", "__low", "__high", F.lit(0).cast("long").alias("opened"))
        if not parts:
            return closed
        dealt = F.broadcast(placed.sparkSession.createDataFrame(parts, "__other string, __leaf int, __members int, __askers int"))
        found = _opened(asked.join(dealt, ["__other", "__leaf"]), placed.withColumnRenamed("__own", "__other").join(
            dealt, ["__other", "__leaf"]), key, ys, share)
        return closed.unionByName(found)


def _opened(asked: DataFrame, members: DataFrame, key: list[str], ys: list[str], share: float) -> DataFrame:
    """What the asked points get from the points of their open leaves, block against block."""
    group = ["__other", "__leaf", "__m", "__a"]
    of = lambda n: F.pmod(F.xxhash64(*ys), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.withColumn("__a", of("__askers")).withColumn("__m", every("__members")).select(*group, *key, *ys)
    right = members.withColumn("__m", of("__members")).withColumn("__a", every("__askers")).select(
        *group, *[F.col(y).alias(y) for y in ys], F.col("__n").cast("double").alias("__n"))
    kinds = {n: k for n, k in asked.dtypes}

    def run(points: pa.Table, there: pa.Table) -> pa.Table:
        n = len(points)
        low, high, pairs = np.zeros(n), np.zeros(n), 0
        if n and len(there):
            low, high, pairs = block_sums(numbers(there, ys), numbers(there, ["__n"])[:, 0], numbers(points, ys), share)
        out = points.select([*key, "__other"])
        for name, values in (("__low", low), ("__high", high)):
            out = out.append_column(name, pa.array(values, pa.float64()))
        return out.append_column("opened", pa.array(np.full(n, pairs // max(n, 1)), pa.int64()))

    schema = ", ".join([f"{c} {kinds[c]}" for c in [*key, "__other"]] + ["__low double", "__high double", "opened long"])
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(run, schema)


def _widths(bounds: DataFrame, xs: list[str], sizes: dict[str, int], name: str) -> DataFrame:
    """``name`` and its ends for each point, from the bounds of its sums of distances."""
    pick = lambda k, c: F.sum(F.when(F.col("__other") == k, F.col(c)))
    sums = bounds.groupBy("__own", *xs, "__n").agg(
        *[pick(k, f"__{end}").alias(f"__{end}{i}") for i, k in enumerate(sizes) for end in ("low", "high")],
        F.sum("opened").alias("opened"))

    def own(end: str):
        return F.coalesce(*[F.when(F.col("__own") == k, F.col(f"__{end}{i}") / F.lit(n - 1.0)) for i, (k, n) in enumerate(sizes.items()) if n > 1],
                          F.lit(None).cast("double"))

    def other(end: str):
        means = [F.when(F.col("__own") != k, F.col(f"__{end}{i}") / F.lit(float(n))) for i, (k, n) in enumerate(sizes.items())]
        return F.least(*means) if len(means) > 1 else F.lit(None).cast("double")

    def width(a, b):
        return F.when(b.isNull(), None).when(a.isNull(), 0.0).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))

    low, high = width(own("high"), other("low")), width(own("low"), other("high"))
    return sums.select("__own", *xs, low.alias(f"{name}_low"), ((low + high) / 2).alias(name), high.alias(f"{name}_high"), "opened", "__n")
