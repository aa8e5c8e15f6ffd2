"""Imports every plan module, which registers its queries."""

from __future__ import annotations

from . import (  # noqa: F401
    attribution_queries,
    model_queries,
    origin_queries,
    panel_queries,
    quality_queries,
    scoring_queries,
    source_queries,
    vintage_queries,
)
from .registry import QUERIES, oracles

__all__ = ["QUERIES", "oracles"]
