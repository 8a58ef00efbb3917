"""All queries over layout, image and result tables, with their oracle SQL."""

from __future__ import annotations

from gridloom.plans import layout, results

QUERIES: dict = {**layout.QUERIES, **results.QUERIES}
ORACLE_SQL: dict[str, str] = {**layout.ORACLE_SQL, **results.ORACLE_SQL}
