"""Every registered query with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import audit, curation, datasets, ingest, ladders, metrics, moderation, policy, reports, rules, sequence, streaming  # noqa: F401  they register their queries
from .plans.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
