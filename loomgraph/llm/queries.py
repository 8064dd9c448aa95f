"""All queries of this subpackage, by name."""

from __future__ import annotations

from loomgraph.llm import documented, packing, pairs, quantiles, splitting, tokenizing, truncation

_MODULES = (documented, truncation, pairs, quantiles, tokenizing, packing, splitting)

QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
