"""All named queries of the core with their SQL twins."""

from __future__ import annotations

from orderloom.plans import audit, core_problems, ledger, matching, matching_sql, ranking

_PARTS = [core_problems, ledger, matching, ranking, audit]


def queries() -> dict:
    return {name: q for part in _PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for part in (core_problems, ledger, matching_sql, audit) for name, q in part.SQL.items()}
