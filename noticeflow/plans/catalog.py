"""All registered queries and their SQL."""

from __future__ import annotations

from noticeflow.plans import analysis, gates, histories, listings, matches, sources, texts  # noqa: F401  (importing registers)
from noticeflow.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = QUERIES["run_scoped_page"]

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
