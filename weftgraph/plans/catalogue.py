"""The registered queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from weftgraph.plans import graph, relational

QUERIES = graph.QUERIES | relational.QUERIES
ORACLE_SQL = graph.SQL | relational.SQL
