"""All queries over the operators, and their DuckDB counterparts."""

from __future__ import annotations

from . import calibration_quality_queries, calibration_queries, comparison_queries, contract_queries, correction_queries, evidence_queries, fusion_queries, identity_queries, inspection_queries, join_queries, lineage_queries, pass_queries, publication_queries, quality_queries, record_queries, resolution_queries, review_queries, scan_queries, scoring_queries, series_queries, temporal_queries, tracking_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
