"""All registered queries with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import more  # noqa: F401 - registers its queries
from .plans.queries import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
