"""Joins that Spark has no method for: as-of, range and interval joins without nested loops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str, tie: str, slice_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """left and `value` of the last right row of the same `by` at or before its time; ties by the largest `tie`.

    Nothing is joined: both sides go through a window by key and slice of time, so
    a hot key is spread over tasks; what a slice ends with is carried to the next
    ones through a table of one row for each key and slice.  slice_of maps a time
    to its slice, in the same order; a day by default.  A null key finds nothing.
    """
    slice_of = slice_of or (lambda t: F.date_trunc("day", t))
    fields = F.struct(*(F.col(c) for c in left.columns)).alias("row")
    none = F.lit(None)
    a = left.select(F.col(by).alias("k"), F.col(left_time).alias("t"), F.lit(1).alias("side"), none.cast(right.schema[tie].dataType).alias("o"), fields, none.cast(right.schema[value].dataType).alias("v"))
    b = right.where(F.col(by).isNotNull() & F.col(right_time).isNotNull()).select(F.col(by).alias("k"), F.col(right_time).alias("t"), F.lit(0).alias("side"), F.col(tie).alias("o"), none.cast(a.schema["row"].dataType).alias("row"), F.col(value).alias("v"))
    both = a.unionByName(b).withColumn("slice", slice_of(F.col("t")))
    right_rows = F.col("side") == 0
    # The last right row up to here within the slice, as a struct: its value may be null.
    w = Window.partitionBy("k", "slice").orderBy("t", "side", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("here", F.last(F.when(right_rows, F.struct("v")), ignorenulls=True).over(w))
    ends = both.groupBy("k", "slice").agg(F.max_by(F.when(right_rows, F.struct("v")), F.when(right_rows, F.struct("t", "o"))).alias("end"))
    before = Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("k").alias("k2"), F.col("slice").alias("s2"), F.last("end", ignorenulls=True).over(before).alias("earlier"))
    found = inside.where("side = 1").join(carried, F.col("k").eqNullSafe(F.col("k2")) & F.col("slice").eqNullSafe(F.col("s2")))
    return found.select("row.*", F.when(F.col("k").isNotNull() & F.col("t").isNotNull(), F.coalesce("here", "earlier")["v"]).alias(value))


def range_join(points: DataFrame, point: Column, ranges: DataFrame, low: Column, high: Column, width: float) -> DataFrame:
    """Rows of points with low <= point < high; an equi-join on buckets of `width`, into which a range is put as often as it meets them."""
    p = points.withColumn("_bucket", F.floor(point / F.lit(width)))
    r = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(low / F.lit(width)), F.floor(high / F.lit(width)))))
    return p.join(r, "_bucket").where((point >= low) & (point < high)).drop("_bucket")


def overlaps(a: DataFrame, b: DataFrame, key: str, a_from: str, a_to: str, b_from: str, b_to: str, slice_of: Callable[[Column], Column]) -> DataFrame:
    """Pairs of the same key whose closed intervals overlap.

    slice_of maps a time to the whole number of its slice, in the same order.  An
    interval is put into each slice that it meets, so a hot key is spread over its
    slices; a pair is taken in the first slice that both meet.
    """
    def sliced(df: DataFrame, start: str, end: str, first: str) -> DataFrame:
        return df.withColumn(first, slice_of(F.col(start))).withColumn("_slice", F.explode(F.sequence(F.col(first), F.greatest(first, slice_of(F.col(end))))))

    met = sliced(a, a_from, a_to, "_a").join(sliced(b, b_from, b_to, "_b"), [key, "_slice"])
    return met.where((F.col("_slice") == F.greatest("_a", "_b")) & (F.col(a_from) <= F.col(b_to)) & (F.col(b_from) <= F.col(a_to))).drop("_slice", "_a", "_b")


def salted_join(large: DataFrame, small: DataFrame, key: str, salts: int) -> DataFrame:
    """An inner join in which a hot key of the large side is spread over `salts` tasks; the small side is repeated for them."""
    left = large.withColumn("_salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [key, "_salt"]).drop("_salt")
