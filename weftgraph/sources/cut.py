"""Cutting lineage with written tables in the shared checkpoint folder, and shipping this package to the workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Gives this package to the session's Python workers, on whatever machine they run."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(sc, "_weft_shipped", False) or not root.is_dir():
        return
    folder = Path(tempfile.mkdtemp(prefix="weft-code-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    packed = folder / f"{root.name}.zip"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(packed))
    sc._weft_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    Where none is set, a local session gets a folder of its own; on a cluster the
    executors would not see each other's files, so that is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="weft-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """The rows of df from a table written now: later plans start there, and a lost executor costs a reread.

    The files go with drop(), or when the session's JVM ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables made by cut() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_weft_path", None)
        if path:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def least_labels(edges: DataFrame) -> DataFrame:
    """node, label for the nodes of edges (a, b): label is the smallest node that is reachable, directions ignored.

    Alternates large-star and small-star steps (Kiveris et al. 2014); each keeps at
    most as many edges as there were, and the loop ends when the edges form stars
    around their smallest nodes.  A hub's edges are never gathered: the least
    neighbour is a partial aggregate, which a join brings back.
    """
    from pyspark.sql import functions as F

    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that both sides of the join are dealt out for it and Spark can split a hub's rows.
        near = cut(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
        large = cut(both.join(near, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = cut(small.where("a <> b").distinct(), "edges")
        same = after.count() == now.count() and after.join(now, ["a", "b"], "left_anti").isEmpty()
        drop(now, near, large, least)
        now = after
        if same:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
