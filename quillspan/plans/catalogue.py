"""The registered queries and their SQL."""

from __future__ import annotations

from quillspan.plans import behavior, economics, files, sessions, sources, spans, text, times, trace, usage  # noqa: F401  each registers its queries
from quillspan.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
