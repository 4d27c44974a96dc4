"""Growth curves as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col


def _number(v) -> Column:
    return F.lit(float(v)) if isinstance(v, (int, float)) else col(v).cast("double")


def logistic(year, capacity, rate, midpoint) -> Column:
    """``capacity / (1 + exp(-rate * (year - midpoint)))``; each argument is a number, a column name or a Column."""
    return _number(capacity) / (1.0 + F.exp(-_number(rate) * (_number(year) - _number(midpoint))))


def year_grid(first, last) -> Column:
    """One row per year when selected: a generator over ``first..last``."""
    bound = lambda v: F.lit(v) if isinstance(v, int) else col(v)
    return F.explode(F.sequence(bound(first), bound(last)))
