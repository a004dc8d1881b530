"""Registered queries against their DuckDB SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def tables(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(v[i]) for i in order) for v in values), key=repr)


def same(spark, sf_dir: str, name: str, query, sql: str) -> None:
    got = query(spark, sf_dir)
    con = tables(sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns), name
    want = rows(names, cur.fetchall())
    have = rows(got.columns, [tuple(r) for r in got.collect()])
    assert len(want) == len(have), (name, len(want), len(have))
    assert have, (name, "no rows prove nothing")
    for a, b in zip(want, have, strict=True):
        for x, y in zip(a, b, strict=True):
            if isinstance(x, float) and isinstance(y, float):
                assert x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12), (name, a, b)
            else:
                assert x == y, (name, a, b)
