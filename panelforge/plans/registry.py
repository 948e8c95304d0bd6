"""All queries of the core and their SQL."""

from __future__ import annotations

from panelforge.plans import intervals_and_asof, news, records

_MODULES = (intervals_and_asof, news, records)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
