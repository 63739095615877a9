"""All registered queries of the library and their DuckDB oracles."""

from __future__ import annotations

from .plans import documents, evaluation, figures, highlights, layout, more, records, requests, rest, retrieval, statements, streams  # noqa: F401  (they register their queries)
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
