"""All queries of the engine by name, with the SQL that DuckDB compares them with."""

from __future__ import annotations

from .plans import addressing, caches, measures, placing, states, temporal

PLANS = (placing, addressing, temporal, caches, states, measures)
QUERIES: dict = {name: q for p in PLANS for name, q in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for p in PLANS for name, sql in p.ORACLE_SQL.items()}
