"""All queries of the core and their SQL counterparts."""

from __future__ import annotations

from lorespark.plans import archive, sessions, upkeep

_MODULES = [sessions, archive, upkeep]

QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
