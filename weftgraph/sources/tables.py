"""Tables with explicit schemas, edge lists and file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: The columns of the tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
EDGES = "src string, dst string, weight bigint"


def schema_of(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table with its schema; it is never inferred."""
    return spark.read.schema(schema_of(name)).parquet(f"{sf_dir}/{name}.parquet")


def read_edges(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """An edge list (src, dst, weight) from parquet, orc, csv with a header, or JSON lines; a malformed row fails the read."""
    reader = spark.read.schema(EDGES)
    if fmt in ("csv", "json"):
        reader = reader.option("mode", "FAILFAST")
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def write_edges(edges: DataFrame, path: str, fmt: str = "parquet", partition: str | None = None) -> None:
    """Writes an edge list; `partition` names a column of few values to partition by."""
    writer = edges.write.format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition:
        writer = writer.partitionBy(partition)
    writer.save(path)


def stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The table as a stream of files."""
    reader = spark.readStream.schema(schema_of(name))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{sf_dir}/{name}.parquet*")
