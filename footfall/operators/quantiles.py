"""Exact quantiles by group, linear interpolation between order statistics.

The built-in exact ``percentile`` keeps every distinct value of a group in one task. Here the work is spread by value:

1. a quantile sketch of the whole column gives marks that cut it into bins of about equal weight;
2. values are counted per (group, value), which combines on the map side and spreads a hot group by value;
3. counts per (group, bin) tell in which bins the wanted ranks of each group lie;
4. only those bins are put in order, one window partition per (group, bin).

The sketch only steers: any marks give the exact answer. A bin holds about ``1 / bins`` of the table, so that is the most
that one task orders, however large a group is; repeated values have been merged before.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import isfinite
from operator import or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import col
from .frames import with_row
from .groups import left_join


def _marks(df: DataFrame, bins: int) -> list[float]:
    """Distinct finite inner bin edges from a sketch of the column ``__x``; at most ``bins - 1`` numbers."""
    found = df.approxQuantile("__x", [i / bins for i in range(1, bins)], 0.25 / bins)
    return sorted({m for m in found if isfinite(m)})


def _holds(rank: Column, start: Column, size: Column) -> Column:
    return (rank >= start) & (rank < start + size)


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], bins: int = 1000,
                    summary: bool = False) -> DataFrame:
    """One row per group: the keys and one column per entry of ``probs``.

    NULL and NaN values are skipped; a group without values gives NULL. ``keys`` may be empty for the whole table.
    ``summary`` adds ``min, mean, max, n_null``, which come from the same counts.
    """
    keys = list(keys)
    by_key = [col(k) for k in keys]
    x = col(value).cast("double")
    rows = df.select(*by_key, F.when(~F.isnan(x), x).alias("__x"))
    edges = [float("-inf"), *_marks(rows, bins), float("inf")]
    counts = rows.groupBy(*by_key, "__x").agg(F.count(F.lit(1)).alias("__c"))
    if len(edges) > 2:
        binned = Bucketizer(splits=edges, inputCol="__x", outputCol="__bin").transform(counts)
    else:
        binned = counts.withColumn("__bin", F.lit(0.0))
    # NULL values get a bin of their own after all others.
    binned = binned.withColumn("__bin", F.when(F.col("__x").isNull(), float(len(edges))).otherwise(F.col("__bin")))

    # Rank interval [start, start + size) of every bin, at most ``bins + 1`` rows per group.
    sizes = binned.groupBy(*by_key, "__bin").agg(F.sum("__c").alias("__size"), F.sum(
        F.when(F.col("__x").isNotNull(), F.col("__c"))).alias("__known"))
    group = Window.partitionBy(*by_key or [F.lit(0)])
    spans = sizes.withColumns({
        "__start": F.sum("__size").over(group.orderBy("__bin")) - F.col("__size"),
        "__n": F.sum("__known").over(group),
    })

    def ranks(p: float) -> tuple[Column, Column]:
        h = (F.col("__n") - 1) * F.lit(float(p))
        return F.floor(h), F.ceil(h)

    wanted = reduce(or_, [_holds(r, F.col("__start"), F.col("__size")) for p in probs.values() for r in ranks(p)])
    spans = spans.filter(wanted).select(*by_key, "__bin", "__start", "__n")

    inside = left_join(binned, spans, [*keys, "__bin"], na_matches=True).filter(F.col("__start").isNotNull())
    in_bin = Window.partitionBy(*by_key, "__bin").orderBy("__x")
    placed = inside.withColumn("__from", F.col("__start") + F.sum("__c").over(in_bin) - F.col("__c"))

    picks = [
        F.max(F.when(_holds(rank, F.col("__from"), F.col("__c")), F.col("__x"))).alias(f"__{side}{i}")
        for i, p in enumerate(probs.values()) for side, rank in zip("ab", ranks(p))
    ]
    found = placed.groupBy(*by_key).agg(F.max("__n").alias("__n"), *picks)

    known = F.sum(F.when(F.col("__x").isNotNull(), F.col("__c")))
    extra = [
        F.min("__x").alias("min"), (F.sum(F.col("__x") * F.col("__c")) / known).alias("mean"), F.max("__x").alias("max"),
        F.coalesce(F.sum(F.when(F.col("__x").isNull(), F.col("__c"))), F.lit(0)).alias("n_null"),
    ] if summary else []
    every = counts.groupBy(*by_key).agg(F.count(F.lit(1)).alias("__values"), *extra)
    out = left_join(every, found, keys, na_matches=True) if keys else with_row(every, found)
    result = {}
    for i, (name, p) in enumerate(probs.items()):
        h = (F.col("__n") - 1) * F.lit(float(p))
        low, high = F.col(f"__a{i}"), F.col(f"__b{i}")
        result[name] = low + (h - F.floor(h)) * (high - low)
    out = out.withColumns(result)
    return out.select(*by_key, *probs, *(["min", "mean", "max", "n_null"] if summary else []))


def value_summary(df: DataFrame, value: str) -> DataFrame:
    """Minimum, quartiles, mean, maximum and number of NULLs of one column, as a one-row frame."""
    quartiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    return group_quantiles(df, [], value, quartiles, summary=True).select(
        "min", "q1", "median", "mean", "q3", "max", "n_null"
    )


def approx_group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                           accuracy: int = 10000) -> DataFrame:
    """Sketch form for one cheap pass: a value of the group whose rank is within ``1 / accuracy`` of the wanted one."""
    return df.groupBy(*[col(k) for k in keys]).agg(
        *[F.percentile_approx(col(value), float(p), F.lit(accuracy)).alias(name) for name, p in probs.items()]
    )
