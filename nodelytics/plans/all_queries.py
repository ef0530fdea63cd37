"""Imports every module that registers queries; ``QUERIES`` and ``SQL`` are whole here."""

from . import chain_job_queries, event_queries, join_queries, operator_queries, order_queries, scan_queries, source_queries, stream_queries, telemetry_job_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
