"""Operators for preparing training text, and their queries."""

from paperloom.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
