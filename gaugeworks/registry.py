"""All queries of the inspection operators, by name, and their SQL."""

from __future__ import annotations

from gaugeworks.plans import drawing, records, review  # noqa: F401
from gaugeworks.plans.inspection import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
