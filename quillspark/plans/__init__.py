"""Registered queries of the report operators and the SQL they must agree with."""

from . import document_queries, layout_queries, legacy_queries, link_queries, markdown_queries, retrieval_queries, section_queries, sequence_queries, structure_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "document_queries", "layout_queries", "legacy_queries", "link_queries", "markdown_queries", "retrieval_queries", "section_queries", "sequence_queries", "structure_queries"]
