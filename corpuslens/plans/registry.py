"""All registered queries and their DuckDB texts."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

AREAS = ("findings", "corpus", "search", "changes", "code", "ranking", "memory", "web", "streams")

for _area in AREAS:
    _module = importlib.import_module(f"corpuslens.plans.{_area}")
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
