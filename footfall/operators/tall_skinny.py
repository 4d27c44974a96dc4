"""QR factor of a tall, narrow matrix whose rows are spread over a cluster.

A task folds its rows into one upper triangle, and triangles are folded into each other, so neither the cross products (which
square the condition number) nor any row leaves its task. A triangle has as many numbers as the matrix has columns, squared.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .fold import fold

#: A column is dependent when less than this share of its length is its own.
DEPENDENT = 1e-11


def folded(triangle: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The upper triangle of the rows seen so far together with these rows."""
    return np.linalg.qr(rows if triangle is None else np.vstack([triangle, rows]), mode="r")


def triangle_of(
    df: DataFrame, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
) -> tuple[np.ndarray, np.ndarray] | None:
    """The triangle of the matrix that ``make`` gives for the rows of ``df``, and the sum of its totals; None without rows.

    ``df`` holds doubles without NULL. ``make`` takes a batch, one line a row, and returns lines of the matrix and a vector of
    totals.
    """
    def add(state, rows):
        lines, sums = make(rows)
        return (folded(None, lines), sums) if state is None else (folded(state[0], lines), state[1] + sums)

    return fold(df, add, lambda a, b: (folded(a[0], b[0]), a[1] + b[1]))


def independent(triangle: np.ndarray, tolerance: float = DEPENDENT) -> list[int]:
    """Places of the columns that are no linear combination of earlier ones, in order.

    The columns of the triangle have the lengths and angles of those of the matrix; each is cleared of the kept ones twice.
    """
    kept: list[int] = []
    basis = np.zeros((triangle.shape[0], 0))
    for j, column in enumerate(triangle.T):
        length = np.linalg.norm(column)
        own = column - basis @ (basis.T @ column)
        own = own - basis @ (basis.T @ own)
        rest = np.linalg.norm(own)
        if length > 0 and rest > tolerance * length:
            kept.append(j)
            basis = np.column_stack([basis, own / rest])
    return kept


def least_squares(triangle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients that give the last column from the others, and the inverse of the cross products of the others."""
    p = triangle.shape[1] - 1
    square = np.linalg.qr(triangle, mode="r")
    inverse = np.linalg.inv(square[:p, :p])
    return inverse @ square[:p, p], inverse @ inverse.T
