"""Query registry of the archive engine."""

from __future__ import annotations

from lodestone.plans import docs_queries, intake_queries, log_queries, more_queries, rule_queries, search_queries  # noqa: F401
from lodestone.plans.registry import ORACLES, QUERIES  # noqa: F401
