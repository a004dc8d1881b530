"""Queries of the relational and streaming layer, each with SQL that computes the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.scalars import cosine, dot
from weftgraph.operators import joins
from weftgraph.sources.cut import shared_folder
from weftgraph.sources.tables import load, read_edges, stream, write_edges
from weftgraph.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# Predicates and joins


@query("r_predicates", "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 10 AND 30 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND p_type NOT LIKE '%zz%' AND regexp_matches(p_name, '[aeiou]') AND p_retailprice IS NOT NULL")
def predicates(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    keep = F.col("p_size").between(10, 30) & F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#23") & ~F.col("p_type").like("%zz%") & F.col("p_name").rlike("[aeiou]") & F.col("p_retailprice").isNotNull()
    return p.where(keep).select("p_partkey", "p_name")


@query("r_null_safe_equal", "SELECT count(*) AS n FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey AND nullif(a.o_orderstatus, 'F') IS NOT DISTINCT FROM nullif(b.o_orderstatus, 'F')")
def null_safe(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    s = F.nullif(F.col("o_orderstatus"), F.lit("F"))
    a, b = o.select(F.col("o_orderkey").alias("k"), s.alias("x")), o.select("o_orderkey", s.alias("y"))
    return a.join(b, (F.col("k") == F.col("o_orderkey")) & F.col("x").eqNullSafe(F.col("y"))).agg(F.count(F.lit(1)).alias("n"))


@query("r_inner_joins", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
def inner_joins(spark, sf_dir):
    o, c, n, r = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("r_outer_joins", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority LIKE '1%' GROUP BY c_custkey")
def outer_joins(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders").where(F.col("o_orderpriority").like("1%"))
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("r_full_join", "SELECT coalesce(s_nationkey, c_nationkey) AS nation, s, c FROM (SELECT s_nationkey, count(*) AS s FROM supplier WHERE s_acctbal > 0 GROUP BY 1) FULL JOIN (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal < 0 GROUP BY 1) ON s_nationkey = c_nationkey")
def full_join(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("s"))
    c = load(spark, sf_dir, "customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("c"))
    return s.join(c, "nation", "full")


@query("r_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(spark, sf_dir):
    o = load(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return load(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("r_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def anti_join(spark, sf_dir):
    o = load(spark, sf_dir, "orders").where(F.col("o_orderpriority").like("1%"))
    return load(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("r_as_of_join", "SELECT a.event_id, b.value FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def as_of_join(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return joins.as_of(left, e.where("event_type = 'click'"), "user_id", "ts", "ts", "value", "event_id").select("event_id", "value")


@query("r_range_join", "SELECT band, count(*) AS n FROM part JOIN (SELECT i AS band, 900 + 50 * i AS lo, 900 + 50 * i + 75 AS hi FROM range(30) AS t(i)) ON p_retailprice >= lo AND p_retailprice < hi GROUP BY band")
def range_join(spark, sf_dir):
    bands = spark.range(30).select(F.col("id").alias("band"), (900 + 50 * F.col("id")).cast("double").alias("lo"), (975 + 50 * F.col("id")).cast("double").alias("hi"))
    j = joins.range_join(load(spark, sf_dir, "part"), F.col("p_retailprice"), bands, F.col("lo"), F.col("hi"), 50.0)
    return j.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query("r_interval_join", "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAY GROUP BY o_orderkey")
def interval_join(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("end"))
    line = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_shipdate")
    month = lambda t: F.floor(F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")) / 30)
    return joins.overlaps(o, line, "k", "start", "end", "l_shipdate", "l_shipdate", month).groupBy(F.col("k").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))


@query("r_lateral_join", "SELECT s_suppkey, x FROM supplier, LATERAL (SELECT s_suppkey * 10 + i AS x FROM range(s_nationkey % 3) AS t(i))")
def lateral_join(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").where("s_nationkey % 3 > 0")
    inner = spark.tvf.explode(F.sequence(F.lit(0), F.col("s_nationkey").outer() % 3 - 1)).toDF("i")
    return s.lateralJoin(inner).select("s_suppkey", (F.col("s_suppkey") * 10 + F.col("i")).alias("x"))


@query("r_salted_join", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity * f), 2) AS q FROM lineitem JOIN (VALUES ('A', 1.0), ('N', 2.0)) AS t(g, f) ON l_returnflag = g GROUP BY l_returnflag")
def salted_join(spark, sf_dir):
    small = spark.createDataFrame([("A", 1.0), ("N", 2.0)], "l_returnflag string, f double")
    j = joins.salted_join(load(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_quantity"), small, "l_returnflag", 16)
    return j.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_quantity") * F.col("f")), 2).alias("q"))


@query("r_theta_join", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def theta_join(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("i"), F.col("n_name").alias("x")), n.select("n_regionkey", F.col("n_nationkey").alias("j"), F.col("n_name").alias("y"))
    return a.join(b, "n_regionkey").where("i < j").select("x", "y")


@query("r_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join(spark, sf_dir):
    return load(spark, sf_dir, "region").crossJoin(load(spark, sf_dir, "nation")).select("r_name", "n_name")


@query("r_broadcast_nl_join", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey > n_nationkey")
def broadcast_nl_join(spark, sf_dir):
    # The table of nations has a fixed size.
    n = F.broadcast(load(spark, sf_dir, "nation"))
    return load(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") > F.col("n_nationkey")).select("s_suppkey", "n_nationkey")


@query("r_shuffle_replicate_nl_join", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey")
def shuffle_replicate_nl_join(spark, sf_dir):
    # The hint makes a Cartesian product, so the tables are the small ones.
    n = load(spark, sf_dir, "nation").hint("shuffle_replicate_nl")
    return load(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_name")


_SEGMENTS = "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"


def _by_strategy(hint: str):
    @query(f"r_{hint}_join", _SEGMENTS)
    def join(spark, sf_dir):
        c = load(spark, sf_dir, "customer").hint(hint)
        return load(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))

    return join


for _hint in ("merge", "shuffle_hash", "broadcast"):
    _by_strategy(_hint)


# Aggregation


@query("r_aggregate", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, min(l_shipdate) AS first, max(l_shipdate) AS last, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def aggregate(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return line.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"),
        F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.count(F.lit(1)).alias("n"),
    )


@query("r_distinct_and_filter", "SELECT event_type, count(DISTINCT user_id) AS users, count(*) FILTER (value > 50) AS big FROM events GROUP BY event_type")
def distinct_and_filter(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count(F.when(F.col("value") > 50, 1)).alias("big"))


_SETS = "SELECT l_returnflag AS f, l_linestatus AS s, grouping_id(l_returnflag, l_linestatus) AS g, count(*) AS n FROM lineitem GROUP BY {}"


def _grouped(grouped) -> DataFrame:
    out = grouped.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), "g", "n")


@query("r_cube", _SETS.format("CUBE (l_returnflag, l_linestatus)"))
def cube(spark, sf_dir):
    return _grouped(load(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus"))


@query("r_rollup", _SETS.format("ROLLUP (l_returnflag, l_linestatus)"))
def rollup(spark, sf_dir):
    return _grouped(load(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus"))


@query("r_grouping_sets", _SETS.format("GROUPING SETS ((l_returnflag), (l_linestatus), ())"))
def grouping_sets(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem")
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    return _grouped(line.groupingSets([[f], [s], []], f, s))


@query("r_quantiles_moments", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.9), 6) AS p90, median(l_quantity) AS mid, round(stddev_samp(l_quantity), 6) AS sd, round(corr(l_quantity, l_extendedprice), 6) AS c FROM lineitem GROUP BY l_returnflag")
def quantiles(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.percentile("l_quantity", 0.9), 6).alias("p90"), F.median("l_quantity").alias("mid"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("c")
    )


@query("r_approximate", "SELECT event_type, count(*) AS n, true AS users_near, true AS mid_near FROM events GROUP BY event_type")
def approximate(spark, sf_dir):
    """Approximate aggregates beside exact ones: within five standard errors, and a hundredth of the rows in rank."""
    e = load(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id", 0.02).alias("users"), F.count_distinct("user_id").alias("exact"), F.percentile_approx("value", 0.5, 10_000).alias("mid"),
        F.percentile("value", 0.49).alias("low"), F.percentile("value", 0.51).alias("high"),
    )
    return e.select("event_type", "n", (F.abs(F.col("users") - F.col("exact")) <= 0.1 * F.col("exact")).alias("users_near"), F.col("mid").between(F.col("low"), F.col("high")).alias("mid_near"))


# Windows, sorting, sets


@query("r_window_ranking", "SELECT o_orderkey, (row_number() OVER w)::INTEGER AS rn, (rank() OVER v)::INTEGER AS rk, (dense_rank() OVER v)::INTEGER AS dr, (ntile(4) OVER w)::INTEGER AS nt, percent_rank() OVER v AS pr, cume_dist() OVER v AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def window_ranking(spark, sf_dir):
    w, v = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(v).alias("rk"), F.dense_rank().over(v).alias("dr"), F.ntile(4).over(w).alias("nt"), F.percent_rank().over(v).alias("pr"), F.cume_dist().over(v).alias("cd")
    )


@query("r_window_analytic", "SELECT event_id, lag(value, 1) OVER w AS a, lead(value, 2) OVER w AS b, first_value(value) OVER w AS c, last_value(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS d, nth_value(value, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_analytic(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return load(spark, sf_dir, "events").select("event_id", F.lag("value").over(w).alias("a"), F.lead("value", 2).over(w).alias("b"), F.first("value").over(w).alias("c"), F.last("value").over(whole).alias("d"), F.nth_value("value", 2).over(whole).alias("e"))


@query("r_window_frames", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM events")
def window_frames(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    # Seconds are rounded to the nearest, halves to even, as the SQL's cast does.
    second = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).cast("long")
    r = Window.partitionBy("user_id").orderBy(second).rangeBetween(-86400, 0)
    return load(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(w), 6).alias("s"), F.count(F.lit(1)).over(r).alias("n"))


@query("r_sort_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def sort_limit(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20)


@query("r_sort_within_partitions", "SELECT o_custkey, o_orderkey, coalesce(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 0.0) AS change FROM orders")
def sort_within(spark, sf_dir):
    """Customers are dealt to partitions and each partition is sorted, so that a pass over it has a customer's orders in a row."""

    def changes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, price = None, 0.0
        for f in frames:
            before = f["o_totalprice"].shift(1)
            new = f["o_custkey"] != f["o_custkey"].shift(1)
            if len(f):
                before.iloc[0], new.iloc[0] = price, f["o_custkey"].iloc[0] != last
                last, price = f["o_custkey"].iloc[-1], f["o_totalprice"].iloc[-1]
            yield f[["o_custkey", "o_orderkey"]].assign(change=(f["o_totalprice"] - before).where(~new, 0.0))

    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return o.repartition("o_custkey").sortWithinPartitions("o_custkey", "o_orderdate", "o_orderkey").mapInPandas(changes, "o_custkey long, o_orderkey long, change double")


def _keys(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return c, load(spark, sf_dir, "supplier").where("s_acctbal > 2000").select(F.col("s_nationkey").alias("k"))


_C, _S = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 2000"


@query("r_union", f"{_C} UNION ALL {_S}")
def union(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.unionByName(b)


@query("r_union_distinct", f"{_C} UNION {_S}")
def union_distinct(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.unionByName(b).distinct()


@query("r_intersect", f"{_C} INTERSECT {_S}")
def intersect(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.intersect(b)


@query("r_intersect_all", f"{_C} INTERSECT ALL {_S}")
def intersect_all(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.intersectAll(b)


@query("r_except", f"{_C} EXCEPT {_S}")
def except_(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.subtract(b)


@query("r_except_all", f"{_C} EXCEPT ALL {_S}")
def except_all(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.exceptAll(b)


@query("r_pivot", "SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS O, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS F FROM lineitem GROUP BY l_returnflag")
def pivot(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.round(F.sum("l_quantity"), 2))


@query("r_unpivot", "SELECT p_partkey, unnest(['p_size', 'p_retailprice']) AS name, unnest([p_size::DOUBLE, p_retailprice]) AS value FROM part")
def unpivot(spark, sf_dir):
    p = load(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return p.unpivot("p_partkey", ["p_size", "p_retailprice"], "name", "value")


# Scalars


@query("r_strings", "SELECT c_custkey, trim('  ' || c_name || ' ') AS a, upper(c_mktsegment) AS b, substr(c_name, 2, 4) AS c, split_part(c_name, '#', 2) AS d, regexp_replace(c_name, '[0-9]+', 'N') AS e, md5(c_name) AS f, length(c_name) AS g, lpad(c_nationkey::VARCHAR, 4, '0') AS h, concat_ws('-', c_name, c_mktsegment) AS i, reverse(c_name) AS j, strpos(c_name, '#') AS k FROM customer")
def strings(spark, sf_dir):
    n = F.col("c_name")
    return load(spark, sf_dir, "customer").select(
        "c_custkey", F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("a"), F.upper("c_mktsegment").alias("b"), F.substring(n, 2, 4).alias("c"), F.split_part(n, F.lit("#"), F.lit(2)).alias("d"), F.regexp_replace(n, "[0-9]+", "N").alias("e"),
        F.md5(n.cast("binary")).alias("f"), F.length(n).cast("long").alias("g"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0").alias("h"), F.concat_ws("-", n, "c_mktsegment").alias("i"), F.reverse(n).alias("j"), F.instr(n, "#").cast("long").alias("k"),
    )


@query("r_dates", "SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS m, year(o_orderdate) AS y, quarter(o_orderdate) AS q, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS d, o_orderdate + INTERVAL 3 DAY AS p, last_day(o_orderdate) AS l, strftime(o_orderdate, '%Y/%m') AS f FROM orders")
def dates(spark, sf_dir):
    d = F.col("o_orderdate")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_trunc("month", d).cast("timestamp_ntz").alias("m"), F.year(d).cast("long").alias("y"), F.quarter(d).cast("long").alias("q"), F.datediff(d.cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("d"),
        (d + F.expr("INTERVAL 3 DAYS")).alias("p"), F.last_day(d.cast("date")).alias("l"), F.date_format(d, "yyyy/MM").alias("f"),
    )


@query("r_math", "SELECT p_partkey, round(p_retailprice / 7, 3) AS a, floor(p_retailprice)::BIGINT AS b, round(ln(p_retailprice), 9) AS c, round(pow(p_size, 1.5), 6) AS d, greatest(p_size, 20) AS e, least(p_size, 20) AS f, p_partkey % 7 AS g, abs(p_size - 25) AS h, p_partkey & 12 AS i FROM part")
def math(spark, sf_dir):
    p, s, k = F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey")
    return load(spark, sf_dir, "part").select(
        "p_partkey", F.round(p / 7, 3).alias("a"), F.floor(p).alias("b"), F.round(F.ln(p), 9).alias("c"), F.round(F.pow(s, F.lit(1.5)), 6).alias("d"), F.greatest(s, F.lit(20)).alias("e"), F.least(s, F.lit(20)).alias("f"), (k % 7).alias("g"), F.abs(s - 25).alias("h"), k.bitwiseAND(12).alias("i")
    )


@query("r_arrays", "SELECT user_id, list_sum(list_transform(list_filter(x, lambda v: v > 10), lambda v: v * 2))::BIGINT AS s, len(list_distinct(x)) AS d, list_contains(x, 7) AS c FROM (SELECT user_id, list(value::BIGINT) AS x FROM events GROUP BY user_id)")
def arrays(spark, sf_dir):
    x = load(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.rint("value").cast("long")).alias("x"))
    doubled = F.transform(F.filter("x", lambda v: v > 10), lambda v: v * 2)
    total = F.when(F.size(doubled) > 0, F.aggregate(doubled, F.lit(0).cast("long"), lambda s, v: s + v))
    return x.select("user_id", total.alias("s"), F.size(F.array_distinct("x")).cast("long").alias("d"), F.array_contains("x", 7).alias("c"))


@query("r_maps", "SELECT user_id, coalesce(m['click'], 0) AS clicks, cardinality(m)::BIGINT AS types FROM (SELECT user_id, map_from_entries(list((event_type, n))) AS m FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id)")
def maps(spark, sf_dir):
    n = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0).cast("long")).alias("clicks"), F.size("m").cast("long").alias("types"))


@query("r_json", "SELECT (props->>'$.k')::INTEGER AS k, count(*) AS n FROM events GROUP BY ALL")
def json(spark, sf_dir):
    k = F.from_json("props", "k int")["k"]
    return load(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("r_json_path", "SELECT event_id, props->>'$.k' AS k, props->>'$.none' AS missing FROM events")
def json_path(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.none").alias("missing"))


@query("r_parse_json", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def parse_json(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "long").alias("k"))


@query("r_explode", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word, generate_subscripts(string_split(p_type, ' '), 1) - 1 AS at FROM part")
def explode(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_type", " ")).alias("at", "word")).select("p_partkey", "word", F.col("at").cast("long").alias("at"))


@query("r_vectors", "SELECT vec_id, round(list_dot_product(e, c), 6) AS d, round(list_cosine_similarity(e, c), 6) AS s FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), (SELECT embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id = 0)")
def vectors(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("c"))
    return e.join(F.broadcast(one)).select("vec_id", F.round(dot(F.col("embedding"), F.col("c")), 6).alias("d"), F.round(cosine(F.col("embedding"), F.col("c")), 6).alias("s"))


# User-defined functions


@query("r_pandas_udf", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge FROM lineitem GROUP BY l_returnflag")
def pandas_udf(spark, sf_dir):
    @F.pandas_udf("double")
    def charge(price: pd.Series, discount: pd.Series, tax: pd.Series) -> pd.Series:
        return price * (1 - discount) * (1 + tax)

    line = load(spark, sf_dir, "lineitem").select("l_returnflag", charge("l_extendedprice", "l_discount", "l_tax").alias("c"))
    return line.groupBy("l_returnflag").agg(F.round(F.sum("c"), 2).alias("charge"))


@query("r_grouped_udf", "SELECT s_nationkey, round(max(s_acctbal) - min(s_acctbal), 2) AS spread FROM supplier GROUP BY s_nationkey")
def grouped_udf(spark, sf_dir):
    def spread(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s_nationkey": [df["s_nationkey"].iloc[0]], "spread": [round(df["s_acctbal"].max() - df["s_acctbal"].min(), 2)]})

    return load(spark, sf_dir, "supplier").groupBy("s_nationkey").applyInPandas(spread, "s_nationkey int, spread double")


@query("r_pandas_udaf", "SELECT c_mktsegment, round(max(c_acctbal) - min(c_acctbal), 2) AS spread FROM customer GROUP BY c_mktsegment")
def pandas_udaf(spark, sf_dir):
    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return x.max() - x.min()

    return load(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.round(spread("c_acctbal"), 2).alias("spread"))


@query("r_arrow_udtf", "SELECT r_name, i AS at, r_name[i + 1] AS letter FROM region, unnest(range(length(r_name))) AS t(i)")
def arrow_udtf(spark, sf_dir):
    @F.arrow_udtf(returnType="r_name string, at long, letter string")
    class Letters:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            names = rows.column("r_name").to_pylist()
            yield pa.table({"r_name": [n for n in names for _ in n], "at": [i for n in names for i in range(len(n))], "letter": [x for n in names for x in n]})

    return Letters(load(spark, sf_dir, "region").select("r_name").asTable())


@query("r_table_udf", "SELECT n_name, unnest(string_split(n_name, '_')) AS word FROM nation")
def table_udf(spark, sf_dir):
    @F.udtf(returnType="word string")
    class Words:
        def eval(self, text: str) -> Iterator[tuple[str]]:
            for word in text.split("_"):
                yield (word,)

    return load(spark, sf_dir, "nation").select("n_name").lateralJoin(Words(F.col("n_name").outer())).select("n_name", "word")


# Streams


_COUNTS = "SELECT {} AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM {} GROUP BY ALL"


def _ntz(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes))


@query("s_tumbling", _COUNTS.format("time_bucket(INTERVAL 1 HOUR, ts)", "events"))
def tumbling(spark, sf_dir):
    events = windows.timed(stream(spark, sf_dir, "events"), "1 hour")
    return _ntz(windows.run_all(windows.counts(events, F.window("ts", "1 hour"))))


@query("s_sliding", _COUNTS.format("start", "(SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start FROM events)"))
def sliding(spark, sf_dir):
    events = windows.timed(stream(spark, sf_dir, "events"), "1 hour")
    return _ntz(windows.run_all(windows.counts(events, F.window("ts", "12 hours", "6 hours"))))


@query("s_sessions", "WITH e AS (SELECT user_id, ts, if(ts - lag(ts) OVER w < INTERVAL 12 HOUR, 0, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS end, count(*) AS n FROM g GROUP BY user_id, g")
def sessions(spark, sf_dir):
    return _ntz(windows.run_all(windows.sessions(windows.timed(stream(spark, sf_dir, "events"), "1 hour"), "12 hours")))


@query("s_deduplicated", "SELECT count(*) AS n, count(DISTINCT (user_id, event_type)) AS kinds FROM (SELECT DISTINCT event_id, user_id, event_type FROM events)")
def deduplicated(spark, sf_dir):
    events = windows.timed(stream(spark, sf_dir, "events"), "60 days").select("event_id", "user_id", "event_type", "ts")
    kept = windows.run_all(windows.deduplicated(events, ["event_id"]), "append")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id", "event_type").alias("kinds"))


@query("s_running_totals", "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY user_id")
def running_totals(spark, sf_dir):
    rows = windows.run_all(windows.running_totals(stream(spark, sf_dir, "events")), "update")
    last = rows.groupBy("user_id").agg(F.max(F.struct("n", "total")).alias("x"))
    return last.select("user_id", "x.n", F.round("x.total", 6).alias("total"))


@query(
    "s_append_with_late_rows",
    "SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
)
def append_with_late_rows(spark, sf_dir):
    """Three batches: the events of the first weeks, the others, and the first week's again, which come too late to count.

    Windows are given when the watermark has passed them, and their state goes.
    """
    events, folder = load(spark, sf_dir, "events"), f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    border = F.lit("2024-01-15").cast("timestamp_ntz")
    for k, part in enumerate((events.where(F.col("ts") < border), events.where(F.col("ts") >= border), events.where(F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz")))):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    late = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    out = _ntz(windows.run_all(windows.counts(windows.timed(late, "1 hour"), F.window("ts", "1 hour")), "append"))
    return out.select("start", "event_type", "n", F.round("total", 6).alias("total"))


# Sources


@query("s2_s3_edges_round_trip", "SELECT f AS format, src, dst, weight FROM (SELECT least(o_custkey, o_orderkey % 97)::VARCHAR AS src, o_orderpriority AS dst, count(*)::BIGINT AS weight FROM orders GROUP BY ALL), (VALUES ('parquet'), ('orc'), ('csv'), ('json')) AS t(f)")
def edges_round_trip(spark, sf_dir):
    """An edge list, written in every format and read again."""
    o = load(spark, sf_dir, "orders")
    edges = o.groupBy(F.least("o_custkey", F.col("o_orderkey") % 97).cast("string").alias("src"), F.col("o_orderpriority").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
    folder, out = f"{shared_folder(spark)}/edges-{uuid.uuid4().hex}", None
    for fmt in ("parquet", "orc", "csv", "json"):
        write_edges(edges, f"{folder}/{fmt}", fmt)
        again = read_edges(spark, f"{folder}/{fmt}", fmt).select(F.lit(fmt).alias("format"), "src", "dst", "weight")
        out = out.unionByName(again) if out else again
    return out
