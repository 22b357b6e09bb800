"""Registered queries and their SQL equivalents."""

from __future__ import annotations

from claimloom.plans import flows  # noqa: F401  registers its queries
from claimloom.plans import queries as q

FLAGSHIP = "b9_degree_all"


def queries() -> dict[str, q.Query]:
    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(q.SQL)
