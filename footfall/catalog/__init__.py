"""Registered queries: every operator run over the shared test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from .registry import QUERIES, SQL
from . import areas, growth, households, segments, training, visits  # noqa: F401  (registration)

__all__ = ["QUERIES", "SQL"]
