"""Per-group rows and flags, and joins on group keys.

A single key may hold a third of all rows. Whatever is grouped here is first reduced on the map side (partial
aggregation, or the per-partition group limit of a top-1 window); full rows are matched with per-key results by
``lookup``, which never sends a hot key to one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import col, if_else


def _same(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], na_matches: bool) -> Column:
    """Equality of key pairs; with ``na_matches`` a NULL key equals a NULL key."""
    tests = [
        left[a].eqNullSafe(right[b]) if na_matches else left[a] == right[b]
        for a, b in pairs
    ]
    return reduce(and_, tests)


def _pairs(on) -> list[tuple[str, str]]:
    if isinstance(on, str):
        on = [on]
    return list(on.items()) if isinstance(on, dict) else [(k, k) for k in on]


def left_join(left: DataFrame, right: DataFrame, on, na_matches: bool = False) -> DataFrame:
    """Left join; ``on`` is a name, a list of names or ``{left name: right name}`` (J1-J4). Right keys are dropped."""
    return _keyed_join(left, right, on, "left", na_matches)


def full_join(left: DataFrame, right: DataFrame, on, na_matches: bool = False) -> DataFrame:
    """Full outer join with the key merged from both sides."""
    return _keyed_join(left, right, on, "full", na_matches)


def _keyed_join(left, right, on, how, na_matches):
    pairs = _pairs(on)
    right = right.withColumnsRenamed({b: f"__r_{b}" for _, b in pairs})
    moved = [(a, f"__r_{b}") for a, b in pairs]
    joined = left.join(right, _same(left, right, moved, na_matches), how)
    if how == "full":
        joined = joined.withColumns({a: F.coalesce(col(a), col(b)) for a, b in moved})
    return joined.drop(*[b for _, b in moved])


def rows_with_key_in(df: DataFrame, keys: DataFrame, on, bounded: bool = False) -> DataFrame:
    """Semi join: rows whose key occurs in another table; nothing is collected.

    ``bounded`` says that the number of keys is limited by their nature (years, months), so they may be broadcast
    without looking at the size of the table they were derived from.
    """
    pairs = _pairs(on)
    right = keys.select(*[col(b).alias(f"__r_{b}") for _, b in pairs])
    right = F.broadcast(right) if bounded else right
    return df.join(right, _same(df, right, [(a, f"__r_{b}") for a, b in pairs], False), "left_semi")


def first_per_group(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order, exactly one per group.

    ``row_number = 1`` is planned with a group limit on both sides of the shuffle: every task forwards at most one row
    per group, so a hot group costs no more than a small one.
    """
    rank = "__rank"
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).drop(rank)


HOT_KEYS = 1000


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], rows: str) -> DataFrame:
    """Left join of a table with one row per key (NULL keys included), safe when a key holds much of ``df``.

    ``rows`` is the column of ``table`` that says how many rows a key has; it is not returned. The ``HOT_KEYS`` largest
    keys, a fixed number, are broadcast, and every key above ``1 / HOT_KEYS`` of all rows is among them. All other keys
    go through the shuffled join. Rows already answered are spread over that join by a hash of the row, so no task
    receives a hot key, whether or not adaptive skew handling is on.
    """
    names = [c for c in table.columns if c not in keys and c != rows]
    hot = table.orderBy(F.desc(rows), *[col(k) for k in keys]).limit(HOT_KEYS).select(
        *[col(k).alias(f"__h_{k}") for k in keys], *[col(c).alias(f"__h_{c}") for c in names], F.lit(True).alias("__hit")
    )
    answered = df.join(F.broadcast(hot), _same(df, hot, [(k, f"__h_{k}") for k in keys], True), "left")
    spread = F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(4096)) + 1
    answered = answered.withColumn("__salt", F.when(F.col("__hit"), spread).otherwise(F.lit(0)))
    # Zero for every key, but not a literal: a literal would leave the join condition and take the salt out of the
    # partitioning. Reading the row count here also lets both branches share one shuffle.
    zero = F.least(col(rows), F.lit(0))
    rest = table.select(
        *[col(k).alias(f"__r_{k}") for k in keys], *[col(c).alias(f"__r_{c}") for c in names], zero.alias("__zero")
    )
    pairs = [(k, f"__r_{k}") for k in keys]
    joined = answered.join(rest, _same(answered, rest, pairs, True) & (answered["__salt"] == rest["__zero"]), "left")
    found = {c: F.when(F.col("__hit"), col(f"__h_{c}")).otherwise(col(f"__r_{c}")) for c in names}
    return joined.select(*[col(c) for c in df.columns], *[v.alias(c) for c, v in found.items()])


def flag_group_min(df: DataFrame, keys: Sequence[str], value: str, name: str,
                   within: DataFrame | None = None) -> DataFrame:
    """1 where ``value`` equals the smallest value of its group, else 0, NULL for a NULL value.

    The minimum is a partial aggregate looked up by key, instead of a window that would put every row of a hot group
    into one task. ``within`` is the table ``df`` was aggregated from: reading just the key and the value there is
    cheaper than repeating the aggregation.
    """
    low = (df if within is None else within).groupBy(*[col(k) for k in keys]).agg(
        F.min(col(value)).alias("__low"), F.count(F.lit(1)).alias("__rows")
    )
    flagged = lookup(df, low, list(keys), "__rows")
    return flagged.withColumn(name, if_else(col(value) == F.col("__low"), 1, 0)).drop("__low")


def complete_groups(df: DataFrame, group: Column, part: Column, parts: int, name: str) -> DataFrame:
    """Groups in which every one of ``parts`` parts occurs (A14): distinct pairs, then a count per group."""
    pairs = df.select(group.alias(name), part.alias("__part")).distinct()
    return pairs.groupBy(name).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == parts).select(name)


def wide_counts(df: DataFrame, row: str, key: str, values: Sequence, prefix: str) -> DataFrame:
    """Long to wide: rows counted per (row, key), one column per listed key, NULL for an empty cell."""
    wide = df.groupBy(row).pivot(key, list(values)).agg(F.count(F.lit(1)))
    return wide.withColumnsRenamed({str(v): f"{prefix}{v}" for v in values})


def cut_at_threshold(df: DataFrame, series: Sequence[str], order: str, value: str, threshold: str | float) -> DataFrame:
    """Each series up to and including the first row at or above the threshold; whole when none is.

    For projected series, whose length is the number of projected years.
    """
    limit = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else col(threshold)
    w = Window.partitionBy(*[col(s) for s in series])
    cut = "__cut"
    reached = F.min(F.when(col(value) >= limit, col(order))).over(w)
    return df.withColumn(cut, reached).filter(F.col(cut).isNull() | (col(order) <= F.col(cut))).drop(cut)
