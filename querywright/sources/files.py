"""Files in and out: columnar and row formats with stated schemas, partitioned and bucketed layouts."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Registry, load, work_folder

R = Registry()
#: About so many rows a file of a partitioned layout.
FILE_ROWS = 5_000_000
FORMATS = ("parquet", "orc", "json", "csv")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared checkpoint folder."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, kind: str = "parquet", *, partition_by: tuple[str, ...] = ()) -> None:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}; known: {', '.join(FORMATS)}")
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    if kind == "csv":
        writer = writer.option("header", True).option("nullValue", "\\N").option("emptyValue", "")
    writer.format(kind).save(path)


def read(spark: SparkSession, path: str, like: DataFrame, kind: str = "parquet") -> DataFrame:
    """Reads with the schema of ``like``, so nothing is inferred."""
    reader = spark.read.schema(like.schema)
    if kind == "csv":
        reader = reader.option("header", True).option("nullValue", "\\N").option("emptyValue", "")
    return reader.format(kind).load(path)


def _round_trip(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    table = load(spark, sf_dir, "customer")
    path = scratch(spark, kind)
    write(table, path, kind)
    return read(spark, path, table, kind)


for _kind in FORMATS:
    R.add(f"source_{_kind}", lambda spark, sf_dir, kind=_kind: _round_trip(spark, sf_dir, kind), "SELECT * FROM customer")


@R.frame("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def source_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout partitioned by status: the filter prunes folders, not rows."""
    path = scratch(spark, "partitioned")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    tasks = math.ceil(orders.count() / FILE_ROWS)  # a folder of many rows is written by many tasks
    write(orders.repartition("o_orderstatus", F.pmod(F.xxhash64("o_orderkey"), F.lit(tasks))), path, partition_by=("o_orderstatus",))
    return spark.read.parquet(path).filter("o_orderstatus = 'F'")
