"""Every operator as a query over the test tables, with its SQL counterpart where SQL can express it."""

from paperloom.queries import flows, language, rows, stats, texts, vectors  # noqa: F401
from paperloom.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
