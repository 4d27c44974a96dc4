"""Hard-negative mining (operator 12): threshold joins over an inverted index with suffix-norm bounds.

Every anchor (a row whose id ``EVERY`` divides) is compared with all rows by the inner product of integer vectors. First its
``FIRST`` best rows of the same label are found, its positives. Then, for each positive, the ``FIRST`` best rows of other
labels whose score lies in the window of 80 to 100 percent of the positive's.

Both are threshold joins. Rows are dealt into blocks, and a block is joined with a block of anchors in one task by an inverted
index over groups of dimensions, those with most weight first. The index leaves out the dimensions of a row from the point on
where the norm of the rest of the row, times the norm of the rest of the anchors, cannot reach the threshold any more. Partial
scores are accumulated group by group; a pair is dropped once partial score plus the product of the remaining norms is below
the anchor's threshold; survivors are scored exactly, in integers. Joins start at a high threshold. Anchors and windows that
are not full yet are joined again at a lower one, until they are full or the threshold has reached the end of the window (for
positives: nothing is excluded). A block returns at most ``FIRST`` rows a window, so no task gets all that an anchor reaches.

Defined results: rows with a null label, a null or empty vector, or null or non-finite components take no part; rows with
equal ids are separate rows (also as anchors) and ties between them are in no particular order; rows with a null id are no
anchors but may be found, after others of the same score; vectors of different length are multiplied over the components both
have; scores must fit a long; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table
from .registry import register

#: Ids of anchors and of rows that get the next label; labels; scale of components; rows wanted for each anchor and window.
EVERY, MOVED, LABELS, SCALE, FIRST = 100, 7, 10, 256, 5
#: The window of a positive score p: LOW * p <= 100 * score <= HIGH * p.
LOW, HIGH = 80, 100
#: Thresholds of the rounds: shares of the largest possible score for positives (None: no threshold), of p for windows.
POSITIVE_ROUNDS, WINDOW_ROUNDS = (0.8, 0.5, 0.25, None), (0.95, 0.88, LOW / 100)
#: Rows and anchors of a block at most, row blocks that small tables are dealt into at most, dimensions of a group.
BLOCK, SPREAD, GROUP = 65_536, 48, 8


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Rows that take part: ``row`` (a number of its own), ``id``, ``label`` and the integer ``vector``."""
    rows = df.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    moved = F.when(F.col("id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    whole = F.transform("vector", lambda x: F.floor(x * SCALE))
    return rows.where("label is not null and vector is not null and size(vector) > 0").where(finite).select(
        F.monotonically_increasing_id().alias("row"), "id", moved.alias("label"), whole.alias("vector"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Integer vectors as rows of ``width`` components, shorter ones filled with 0."""
    found = column.combine_chunks()
    if isinstance(found, pa.ChunkedArray):
        found = found.chunk(0) if found.num_chunks else pa.array([], pa.list_(pa.int64()))
    values, sizes = found.flatten().to_numpy(zero_copy_only=False), np.diff(found.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def rest_norms(x: np.ndarray, group: int) -> np.ndarray:
    """For each group of dimensions the norm of what comes from it on, and zeros behind the last; a row a group."""
    starts = np.arange(0, x.shape[1], group)
    squares = np.add.reduceat(x.astype(np.float64) ** 2, starts, axis=1)
    rest = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]) * (1 + 1e-9)
    return np.vstack([rest.T, np.zeros(len(x))])


def threshold_join(anchors: np.ndarray, least: np.ndarray, rows: np.ndarray, group: int = GROUP) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor, the rows whose inner product with it is at least its threshold, and these products."""
    order = np.argsort(-(rows.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    q, x = np.ascontiguousarray(anchors[:, order]), np.ascontiguousarray(rows[:, order])
    q_rest, x_rest = rest_norms(q, group), rest_norms(x, group)
    reachable = q_rest.max(axis=1)[:, None] * x_rest >= least.min()  # at group g: the rest of the row still matters
    reachable[-1] = False
    indexed = reachable.sum(axis=0)  # rests shrink, so the groups of a row that are indexed come first
    parts = [x[:, g * group:(g + 1) * group].astype(np.float64) for g in range(len(q_rest) - 1)]
    postings = np.flatnonzero(indexed > 0)
    for i in range(len(q)):
        at, partial, ended = postings, np.zeros(len(postings)), []
        slack = 1e-6 * (1 + abs(least[i]))
        for g, part in enumerate(parts):
            here = indexed[at] > g
            if not here.all():
                ended.append(at[~here])  # beyond its index a row is scored as a whole
                at, partial = at[here], partial[here]
            partial = partial + part[at] @ q[i, g * group:(g + 1) * group].astype(np.float64)
            open_ = partial + q_rest[g + 1, i] * x_rest[g + 1, at] >= least[i] - slack
            at, partial = at[open_], partial[open_]
        at = np.concatenate([at, *ended]) if ended else at
        score = x[at] @ q[i]
        good = score >= least[i]
        yield i, at[good], score[good]


def best(score: np.ndarray, ids: np.ndarray, first: int) -> np.ndarray:
    """Places of the ``first`` best: by score, then by id."""
    if len(score) > 8 * first:
        keep = np.flatnonzero(score >= np.partition(score, -first)[-first])
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))[:first]]


NO_ID = np.iinfo(np.int64).max
FOUND = "anchor long, window long, row long, id long, score long"


def in_blocks(queries: DataFrame, rows: DataFrame, anchor_blocks: int, row_blocks: int, search) -> DataFrame:
    """What ``search`` finds for each block of anchors and block of rows, as ``FOUND``.

    ``queries`` has ``anchor`` among its columns. A row is sent to each block of anchors and an anchor to each block of rows.
    """
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("*", of("anchor", anchor_blocks).alias("a"), every(row_blocks).alias("b"))
    right = rows.select("*", of("row", row_blocks).alias("b"), every(anchor_blocks).alias("a"))

    def run(asked: pa.Table, there: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        if len(asked) and len(there):
            names = [c for c in asked.column_names if c not in ("a", "b", "vector")]
            values = {c: asked.column(c).to_numpy() for c in names if asked.schema.field(c).type == pa.int64()}
            values |= {c: asked.column(c).to_numpy() for c in names if c == "least"}
            values |= {c: asked.column(c).to_pylist() for c in names if c == "windows"}
            width = max(pc.max(pc.list_value_length(t.column("vector"))).as_py() for t in (asked, there))
            ids = there.column("id").fill_null(NO_ID).to_numpy()
            data = {"row": there.column("row").to_numpy(), "label": there.column("label").to_numpy(), "id": ids}
            for found in search(values, matrix(asked.column("vector"), width), data, matrix(there.column("vector"), width)):
                for column, values_ in zip(out, found, strict=True):
                    column.append(np.broadcast_to(values_, found[2].shape))
        made = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
        return pa.table(dict(zip(["anchor", "window", "row", "id", "score"], made, strict=True)))

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(run, FOUND)


def _same_label(first: int):
    def search(asked, vectors, there, rows):
        for i, at, score in threshold_join(vectors, asked["least"], rows):
            fits = (there["label"][at] == asked["label"][i]) & (there["row"][at] != asked["anchor"][i])
            at, score = at[fits], score[fits]
            k = best(score, there["id"][at], first)
            yield asked["anchor"][i], 0, there["row"][at[k]], there["id"][at[k]], score[k]

    return search


def _other_label(first: int):
    def search(asked, vectors, there, rows):
        for i, at, score in threshold_join(vectors, asked["least"], rows):
            fits = there["label"][at] != asked["label"][i]
            at, score = at[fits], score[fits]
            for top in asked["windows"][i]:
                inside = np.flatnonzero((100 * score <= HIGH * top) & (100 * score >= LOW * top))
                k = inside[best(score[inside], there["id"][at[inside]], first)]
                yield asked["anchor"][i], top, there["row"][at[k]], there["id"][at[k]], score[k]

    return search


def ranked(found: DataFrame, first: int) -> DataFrame:
    """The ``first`` best rows of each anchor and window over all blocks, with their ``rank``."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)


def hard_negatives(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = EVERY, first: int = FIRST,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = cut(usable(df, key, vector, label).withColumn("norm", norm))
    anchors = rows.where(F.col("id") % every == 0).withColumnRenamed("row", "anchor")
    n, longest = rows.agg(F.count(F.lit(1)), F.max("norm")).first()
    asked = anchors.count()
    anchor_blocks = max(1, -(-asked // BLOCK))
    row_blocks = max(1, -(-n // BLOCK), min(SPREAD, n // 1024))
    there = rows.select(*[F.col(c).alias(c) for c in ("row", "id", "label", "vector")])  # columns of their own beside the anchors'

    open_, positives = anchors.select("anchor", "label", "vector", "norm"), None
    for share in POSITIVE_ROUNDS:
        least = F.lit(float("-inf")) if share is None else F.col("norm") * F.lit(share * (longest or 0.0))
        queries = open_.select("anchor", "label", "vector", least.alias("least"))
        found = cut(ranked(in_blocks(queries, there, anchor_blocks, row_blocks, _same_label(first)), first))
        full = found if share is None else found.join(
            found.groupBy("anchor").count().where(F.col("count") == first), "anchor", "left_semi")
        positives = full if positives is None else positives.unionByName(full)
        open_ = open_.join(full.select("anchor").distinct(), "anchor", "left_anti")
    positives = cut(positives.select("anchor", F.col("id").alias("positive"), F.col("score").alias("window")))

    tops = positives.where("window >= 0").select("anchor", "window").distinct()
    results = None
    for share in WINDOW_ROUNDS:
        lowest = (F.ceil(F.min("window") * (LOW / 100)) - 1).cast("double") if share == WINDOW_ROUNDS[-1] else F.min("window") * share
        wanted = tops.groupBy("anchor").agg(F.array_sort(F.collect_list("window")).alias("windows"), lowest.alias("least"))
        queries = anchors.select("anchor", "label", "vector").join(wanted, "anchor").select("anchor", "label", "vector", "windows", "least")
        found = cut(ranked(in_blocks(queries, there, anchor_blocks, row_blocks, _other_label(first)), first))
        full = found if share == WINDOW_ROUNDS[-1] else found.join(
            found.groupBy("anchor", "window").count().where(F.col("count") == first), ["anchor", "window"], "left_semi")
        results = full if results is None else results.unionByName(full)
        tops = tops.join(full.select("anchor", "window").distinct(), ["anchor", "window"], "left_anti")
    named = anchors.select("anchor", F.col("id").alias("anchor_id"))
    whole = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return positives.join(named, "anchor").join(results, ["anchor", "window"]).select(
        "anchor_id", whole("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), whole("id").alias("negative_id"),
        F.col("window").alias("positive_score"), F.col("score").alias("negative_score"))


@register("op12_hard_negatives")
def op12_hard_negatives(spark, sf_dir):
    return hard_negatives(table(spark, sf_dir, "embeddings"))
