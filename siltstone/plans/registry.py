"""The registered queries and the SQL that each must equal."""

from __future__ import annotations

from . import data_queries, exam_queries, page_queries, quality_queries, report_queries, retrieval_queries, run_queries, scoring_queries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
