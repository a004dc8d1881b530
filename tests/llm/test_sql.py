"""Every query of the subpackage that has SQL, against DuckDB."""

from __future__ import annotations

import pytest
from compare import same

from weftgraph.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_duckdb(spark, name):
    same(spark, SF, name, queries.QUERIES[name], queries.ORACLE_SQL[name])
