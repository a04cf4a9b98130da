"""Name -> query builder and name -> SQL, gathered from the plan modules."""

from __future__ import annotations

from .plans import decisions, exchange, lifecycle, pilots, quality, records, reports, suites, surface, telemetry  # noqa: F401  each adds its queries
from .plans.surface import QUERIES, SQL

ORACLE_SQL = SQL
__all__ = ["ORACLE_SQL", "QUERIES"]
