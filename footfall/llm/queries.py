"""All queries of this subpackage; importing this module registers them."""

from __future__ import annotations

from . import (  # noqa: F401
    line_dedup, near_texts, negatives, packing, pages, quality, secrets, segmentation, sharding, spelling, token_counts, toxicity, vectors,
)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
