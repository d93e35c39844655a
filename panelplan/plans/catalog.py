"""All registered queries of the planning library and their DuckDB texts."""

from __future__ import annotations

from panelplan.plans import details, learned, storage, structure  # noqa: F401  they register their queries
from panelplan.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
