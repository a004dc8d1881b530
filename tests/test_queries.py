"""Every query of the engine that has SQL, against DuckDB; the others against what must hold."""

from __future__ import annotations

import pytest
from compare import same

from weftgraph.operators import random_graphs
from weftgraph.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_duckdb(spark, name):
    same(spark, SF, name, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_rewired_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(random_graphs, "NUMBERED", 100)
    same(spark, SF, "n6_rewired", catalogue.QUERIES["n6_rewired"], catalogue.ORACLE_SQL["n6_rewired"])


def test_window_frames_round_seconds(spark, tmp_path):
    ts = ["2024-01-01 00:00:00.4", "2024-01-02 00:00:00.6", "2024-01-03 00:00:00.5", "2024-01-04 00:00:01.5", "2024-01-05 00:00:02.5", "2024-01-06 00:00:02.500001", "1969-12-31 23:59:58.5"]
    rows = ", ".join(f"({i}L, TIMESTAMP_NTZ '{t}', 1L, 'view', {i}.5D, '')" for i, t in enumerate(ts))
    spark.sql(f"SELECT * FROM VALUES {rows} AS t(event_id, ts, user_id, event_type, value, props)").toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    same(spark, str(tmp_path), "r_window_frames", catalogue.QUERIES["r_window_frames"], catalogue.ORACLE_SQL["r_window_frames"])
