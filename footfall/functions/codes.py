"""Category codes and income brackets."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col, if_else, literal, quoted

# Education labels of the visit export on the 1-9 scale. Code 6 belongs to a label that is already
# taken by code 4, so it never occurs.
EDUCATION_1_9 = [
    ("No Schooling", 1),
    ("Currently Preschool and younger", 2),
    ("Currently K-8", 3),
    ("Drop Out K-12", 4),
    ("Currently High School", 5),
    ("HS/HiSET Graduate", 7),
    ("Some College", 8),
    ("College Graduate (2 year, 4 year, or beyond)", 9),
    ("Unknown", None),
    ("Not Selected", None),
]

# Education labels of the second export on the 0-11 scale.
EDUCATION_0_11 = [
    ("Pre-K and younger (Currently)", 1),
    ("No Schooling", 2),
    ("K-8 (Currently)", 3),
    ("Low Grade Grad", 4),
    ("9-12 (Currently)", 5),
    ("K-12 Drop Out", 6),
    ("HSED / GED Grad (or current)", 7),
    ("HS Grad", 8),
    ("HS Grad / Some College", 9),
    ("College 2 or 4 yr  Degree", 10),
    ("College Advanced Degree", 11),
    ("Unknown", 0),
    ("Not Selected", 0),
]

# Lower bounds of income brackets 2-16 (half-open, bracket 1 lies below the first).
INCOME_EDGES = [
    10000, 15000, 20000, 25000, 30000, 35000, 40000, 45000, 50000, 60000, 75000, 100000, 125000, 150000, 200000,
]

# The income that stands for each bracket.
INCOME_MIDPOINTS = [
    5000, 12500, 17500, 22500, 27500, 32500, 37500, 42500, 47500, 55000, 67500, 87500, 112500, 137500, 175000, 225000,
]


def code_of(name: str, scale: Sequence[tuple[str, int | None]]) -> Column:
    """Code of the label in a column; unknown labels and NULL give NULL."""
    arms = " ".join(f"WHEN {literal(label)} THEN {code}" for label, code in scale if code is not None)
    return F.expr(f"CASE {quoted(name)} {arms} END")


def yes_flag(c: str | Column) -> Column:
    """1 for exactly "Yes", 0 for anything else, NULL for NULL."""
    return if_else(col(c) == "Yes", 1, 0)


def yes_flag_any_case(c: str | Column) -> Column:
    return if_else(F.lower(col(c)) == "yes", 1, 0)


def bracket_number(name: str, edges: Sequence[float] = INCOME_EDGES) -> Column:
    """1..len(edges)+1; everything below the first edge (negative values too) is 1, NULL stays NULL."""
    x = f"CAST({quoted(name)} AS DOUBLE)"
    arms = " ".join(f"WHEN {x} < {float(edge)!r}D THEN {i}" for i, edge in enumerate(edges, 1))
    return F.expr(f"CASE WHEN {x} IS NULL THEN NULL {arms} ELSE {len(edges) + 1} END")


def bracket_label(name: str, edges: Sequence[float] = INCOME_EDGES, prefix: str = "income") -> Column:
    """``income1`` .. ``income16``."""
    return F.concat(F.lit(prefix), bracket_number(name, edges).cast("string"))


def counts_by_code(name: str, codes: Iterable[int], prefix: str, open_end: bool = False) -> list[Column]:
    """One conditional count per code, all filled in a single pass; the last takes ``>=`` when ``open_end``."""
    codes = list(codes)
    test = lambda code: ">=" if open_end and code == codes[-1] else "="
    return [F.expr(f"count_if({quoted(name)} {test(code)} {code}) AS {quoted(f'{prefix}{code}')}") for code in codes]
