"""All registered reference queries."""

from __future__ import annotations

from . import curation_queries, label_queries, mart_queries, motion_queries, output_queries, record_queries, scene_queries, structure_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
