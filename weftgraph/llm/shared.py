"""What the operators of this subpackage share: tables, runs of rows, lean Python workers."""

from __future__ import annotations

import ctypes
import functools
import gc
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from weftgraph.sources.cut import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Batches = Iterator[pa.RecordBatch]


def lean(fn: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """fn, which gives the memory that its task has used back to the system: Python workers stay for later tasks."""

    @functools.wraps(fn)
    def over(batches: Batches) -> Batches:
        try:
            yield from fn(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return over


def in_arrow(df: DataFrame, fn: Callable[[Batches], Batches], added: list[StructField] = []) -> DataFrame:  # noqa: B006
    """fn over df's columns by place, whatever their names, which are df's again after it; `added` fields come last."""
    ship(df.sparkSession)
    plain = [f"c{i}" for i in range(len(df.columns))]
    schema = StructType([StructField(n, f.dataType) for n, f in zip(plain, df.schema.fields, strict=True)] + added)
    return df.toDF(*plain).mapInArrow(lean(fn), schema).toDF(*df.columns, *(f.name for f in added))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, from batches sorted by them; a batch's runs stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k) for k in keys]
        last = batch.num_rows - 1
        cut = 0
        same = np.ones(batch.num_rows, bool)
        for c in cols:
            v = c.to_numpy(zero_copy_only=False)
            same &= v == v[last]
        if not same.all():
            cut = int(np.flatnonzero(~same)[-1]) + 1
        if held:
            before = held[-1]
            joined = all(before.column(k)[before.num_rows - 1] == batch.column(k)[0] for k in keys)
            if not joined or cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held)
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        else:
            if cut:
                yield pa.Table.from_batches([batch.slice(0, cut)])
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def by_run(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn over tables of whole runs of equal keys (never null), many small runs at a time."""

    @lean
    def over(batches: Batches) -> Batches:
        return itertools.chain.from_iterable(map(fn, runs(batches, keys)))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(over, schema)
