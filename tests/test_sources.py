from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from weftgraph.operators import joins
from weftgraph.plans import catalogue
from weftgraph.sources import tables
from weftgraph.streaming import windows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_edges_round_trip(spark, tmp_path, fmt):
    e = spark.createDataFrame([("a", "b", 1), ("c", "d,e", 2)], tables.EDGES)
    tables.write_edges(e, str(tmp_path / fmt), fmt)
    assert sorted(map(tuple, tables.read_edges(spark, str(tmp_path / fmt), fmt).collect())) == [("a", "b", 1), ("c", "d,e", 2)]


def test_malformed_edges_fail(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"src": "a", "dst": "b", "weight": 1}\n{"src": broken\n')
    with pytest.raises(Exception):
        tables.read_edges(spark, str(tmp_path / "x.json"), "json").collect()


@pytest.mark.parametrize("name", sorted(tables.SCHEMAS))
def test_schemas_are_the_files(spark, name):
    assert tables.load(spark, SF, name).dtypes == spark.read.parquet(f"{SF}/{name}.parquet").dtypes


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())


def test_joins_on_edges_of_intervals(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, None, 5), (4, "k", 3)], "id int, k string, t int")
    right = spark.createDataFrame([("k", 3, 10, 1), ("k", 3, 11, 2), ("k", 6, 12, 3), (None, 1, 13, 4)], "k string, u int, v int, o int")
    for width in (1, 2, 100):
        got = joins.as_of(left, right, "k", "t", "u", "v", "o", lambda t, n=width: F.floor(t / n)).collect()
        assert sorted((r["id"], r["v"]) for r in got) == [(1, 11), (2, None), (3, None), (4, 11)]
    p = spark.createDataFrame([(x / 2,) for x in range(20)], "x double")
    r = spark.createDataFrame([(0, 1.0, 2.0), (1, 1.5, 7.25), (2, 3.0, 3.0)], "r int, lo double, hi double")
    got = joins.range_join(p, p["x"], r, r["lo"], r["hi"], 2.0).collect()
    assert sorted((g["r"], g["x"]) for g in got) == sorted((i, x / 2) for x in range(20) for i, lo, hi in [(0, 1.0, 2.0), (1, 1.5, 7.25), (2, 3.0, 3.0)] if lo <= x / 2 < hi)


def test_late_events_are_dropped_and_repeats_removed(spark, tmp_path):
    def put(n, rows):
        frame = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
        frame["ts"] = pd.to_datetime(frame["ts"]).astype("datetime64[us]")
        frame.to_parquet(tmp_path / f"events.parquet{n}", index=False)

    put(1, [(1, "2024-01-01 10:00", 1, "a", 1.0, "{}"), (1, "2024-01-01 10:00", 1, "a", 1.0, "{}"), (2, "2024-01-01 14:00", 1, "a", 2.0, "{}")])
    put(2, [(3, "2024-01-01 15:00", 1, "a", 4.0, "{}"), (2, "2024-01-01 14:00", 1, "a", 2.0, "{}")])
    put(3, [(4, "2024-01-01 09:00", 1, "a", 8.0, "{}"), (5, "2024-01-01 20:00", 1, "a", 16.0, "{}")])
    events = windows.timed(tables.stream(spark, str(tmp_path), "events", 1), "1 hour")
    kept = windows.run_all(windows.deduplicated(events, ["event_id"]), "append")
    assert sorted(r["event_id"] for r in kept.collect()) == [1, 2, 3, 5]
