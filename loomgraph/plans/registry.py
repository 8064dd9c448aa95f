"""All queries of the core, by name."""

from __future__ import annotations

from loomgraph.plans import code, graph, java, metrics, references, scope, search, sinks, streams, workflow

_MODULES = (references, metrics, graph, java, search, scope, workflow, code, sinks, streams)

QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
