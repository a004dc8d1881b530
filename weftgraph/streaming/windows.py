"""Streaming aggregations over files of events."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from weftgraph.sources.cut import shared_folder


def timed(events: DataFrame, delay: str) -> DataFrame:
    """events with ts as a timestamp, which a watermark needs, and the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def counts(events: DataFrame, window: Column) -> DataFrame:
    """start, event_type, n, total for each window and type."""
    out = events.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """user_id, start, end, n: a user's events with less than `gap` between them."""
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: list[str]) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.dropDuplicatesWithinWatermark(key)


def running_totals(events: DataFrame) -> DataFrame:
    """user_id, n, total: a custom stateful operator that keeps each user's count and sum and gives them after each batch."""

    def step(key, frames, state):
        n, total = state.get if state.exists else (0, 0.0)
        for frame in frames:
            n, total = n + len(frame), total + float(frame["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    rows = events.select("user_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def run_all(stream: DataFrame, mode: str = "complete", keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs the stream over all that is there and returns what it has written.

    complete: each batch replaces the table; append and update: batches are added.
    State and output are in the shared folder.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        out = keep(batch) if keep else batch
        name = "all" if mode == "complete" else f"b{number}"
        out.write.mode("overwrite").parquet(f"{folder}/out/part={name}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out").select(*stream.columns)
