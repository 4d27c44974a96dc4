"""NULL rules that differ between data-frame languages and SQL, as Column helpers."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column name for SQL text, quoted so that blanks and dots are literal."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A string literal for SQL text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def col(c: str | Column) -> Column:
    return c if isinstance(c, Column) else F.col(quoted(c))


def if_else(condition: Column, yes, no) -> Column:
    """Conditional whose result is NULL when the condition is NULL."""
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(condition, lift(yes)).when(~condition, lift(no))


def is_in(c: str | Column, values: Iterable) -> Column:
    """Membership that is never NULL: a NULL is simply not a member."""
    return F.coalesce(col(c).isin(list(values)), F.lit(False))


# Expressions over many columns are written as SQL text: one call to the JVM instead of several per column.


def row_sum(names: Iterable[str]) -> Column:
    """Sum across columns, NULLs skipped."""
    return F.expr(" + ".join(f"coalesce(CAST({quoted(c)} AS DOUBLE), 0D)" for c in names))


def weighted_sum(names: Iterable[str], weights: Iterable[float]) -> Column:
    """Weight j goes to column j; NULL when a count is NULL."""
    return F.expr(" + ".join(f"{quoted(c)} * {float(w)!r}D" for c, w in zip(names, weights, strict=True)))


def plain_sum(names: Iterable[str]) -> Column:
    """Sum across columns, NULL when one is NULL."""
    return F.expr(" + ".join(quoted(c) for c in names))


def pmin(*columns: str | Column) -> Column:
    """Row-wise minimum, NULL as soon as one input is NULL."""
    cs = [col(c) for c in columns]
    return F.when(~reduce(or_, [c.isNull() for c in cs]), F.least(*cs))


def ratio(top: str | Column, bottom: str | Column) -> Column:
    """Division that gives NULL for a zero divisor."""
    return F.try_divide(col(top), col(bottom))


def sums_or_zero(names: Iterable[str]) -> list[Column]:
    """Aggregates: sums under their own names that skip NULLs and are 0 for a group without values (A3)."""
    return [F.expr(f"coalesce(sum({quoted(c)}), 0D) AS {quoted(c)}") for c in names]


def strict_sum(c: str | Column) -> Column:
    """Aggregate: sum that is NULL when any value in the group is NULL (A4)."""
    return F.when(F.count(col(c)) == F.count(F.lit(1)), F.sum(col(c)))


def n_distinct(c: str | Column) -> Column:
    """Aggregate: exact distinct count in which NULL counts as one value (A10)."""
    has_null = F.max(col(c).isNull().cast("bigint"))
    return F.count_distinct(col(c)) + F.coalesce(has_null, F.lit(0))


def approx_n_distinct(c: str | Column, rsd: float = 0.02) -> Column:
    """Aggregate: the sketch form of ``n_distinct`` for very large key sets."""
    has_null = F.max(col(c).isNull().cast("bigint"))
    return F.approx_count_distinct(col(c), rsd) + F.coalesce(has_null, F.lit(0))


def one_or_multi(c: str | Column, many: str = "Multi") -> Column:
    """Aggregate: the group's only value, else ``many``; NULL is a value of its own.

    Minimum, maximum and two counts decide it, so the group is combined on the map side and needs no distinct.
    """
    x = col(c)
    single = (F.count(x) == F.count(F.lit(1))) & (F.min(x) == F.max(x))
    return F.when(F.count(x) == 0, F.lit(None)).when(single, F.min(x)).otherwise(F.lit(many))


def first_by(value: str | Column, *order: str | Column) -> Column:
    """Aggregate: the value of the first row in the given order, NULL keys last.

    Every ordering column is preceded by its null flag: an ordering of flags and values never meets a bare NULL.
    The value itself closes the order, so the result does not depend on the arrival of rows.
    """
    keys = [part for o in [*order, value] for part in (col(o).isNull(), col(o))]
    return F.min_by(col(value), F.struct(*keys))
