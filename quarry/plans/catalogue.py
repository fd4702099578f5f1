"""All queries over the reference's kind of operators, by name."""

from __future__ import annotations

from quarry.plans import analytics, corpus, lineage, relational, service, texts  # noqa: F401  registers their queries
from quarry.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
