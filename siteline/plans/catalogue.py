"""Every registered query, with its SQL."""

from __future__ import annotations

from siteline.plans import q_files, q_intervals, q_scores, q_tables
from siteline.plans.registry import Query

MODULES = [q_intervals, q_tables, q_scores, q_files]
FLAGSHIP: Query = q_intervals.flagship


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.R.sql.items()}
