"""The queries of the library by name, and SQL for the same rows where SQL can express them."""

from __future__ import annotations

from meridia.queries import casebook, clinical, embeddings, events, tables

_MODULES = (embeddings, events, tables, clinical, casebook)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
