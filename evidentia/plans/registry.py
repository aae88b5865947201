"""All core queries by name, and their SQL."""

from __future__ import annotations

from evidentia.plans.core import queries
from evidentia.plans.sql import oracle_sql

__all__ = ["oracle_sql", "queries"]
