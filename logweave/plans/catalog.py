"""Imports every module that registers queries."""

from . import cluster_queries, log_queries, sequence_queries, stream_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
