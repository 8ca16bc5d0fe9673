"""All queries of the core, and their SQL."""

from __future__ import annotations

from lodestone.plans import hot_keys, retrieval

_MODULES = [hot_keys, retrieval]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
