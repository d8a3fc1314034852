"""Registered queries and their DuckDB counterparts."""

from . import evidence, facts, graphs, operations, packages, ranges, texts, workflow
from .registry import COVERS, ORACLE, QUERIES

__all__ = ["COVERS", "ORACLE", "QUERIES", "evidence", "facts", "graphs", "operations", "packages", "ranges", "texts", "workflow"]
