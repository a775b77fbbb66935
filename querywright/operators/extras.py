"""Constructs that Spark SQL lacks, as DataFrame functions.

``QUALIFY``, FILTER and DISTINCT inside window aggregates, JSON paths on strings, ``iff`` and
``count_distinct``, and recursion with UNION (distinct).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from heapq import heappop, heappush, heappushpop

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..tables import Registry, load, work_folder

R = Registry()


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a condition over window functions holds; no helper column remains."""
    hidden = f"__qualify_{uuid.uuid4().hex[:8]}"
    return df.withColumn(hidden, condition).filter(F.col(hidden)).drop(hidden)


def filtered_over(aggregate: Callable[[Column], Column], value: Column, condition: Column, window: WindowSpec) -> Column:
    """``aggregate(value) FILTER (WHERE condition) OVER window`` for aggregates that skip nulls."""
    return aggregate(F.when(condition, value)).over(window)


def with_distinct(df: DataFrame, keys: Sequence[str], value: str, *, count: str | None = None, total: str | None = None) -> DataFrame:
    """``count(DISTINCT value)`` and ``sum(DISTINCT value)`` OVER (PARTITION BY keys), added as columns.

    Distinct (keys, value) rows are aggregated and joined back, so a large group is never held in one row.  Null keys form a
    group; a sum without known values is null.
    """
    wanted = [*([F.count(value).alias(count)] if count else []), *([F.sum(F.col(value).cast("double")).alias(total)] if total else [])]
    hidden = {k: f"__{n}_{uuid.uuid4().hex[:6]}" for n, k in enumerate(keys)}
    per = df.select(*keys, value).distinct().groupBy(*keys).agg(*wanted).select(*[F.col(k).alias(h) for k, h in hidden.items()], *[c for c in (count, total) if c])
    match = reduce(lambda a, b: a & b, [df[k].eqNullSafe(per[h]) for k, h in hidden.items()])
    return df.join(per, match, "left").drop(*hidden.values())


def running_median(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``median(value) OVER (PARTITION BY keys ORDER BY order)`` up to each row, which Spark's own refuses; nulls count for nothing.

    Two heaps a group, so a group of n rows takes n log n steps; like any ordered window a group is one task's.
    """
    place = df.columns.index(value)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in order])
        low: list[float] = []  # the smaller half, negated
        high: list[float] = []
        out: list[float | None] = []
        for x in rows.column(place).to_pylist():
            if x is not None:
                heappush(high, -heappushpop(low, -float(x)))
                if len(high) > len(low):
                    heappush(low, -heappop(high))
            out.append(None if not low else -low[0] if len(low) > len(high) else (high[0] - low[0]) / 2)
        return rows.append_column(name, pa.array(out, pa.float64()))

    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])
    return df.groupBy(*keys).applyInArrow(run, schema)


def with_place(df: DataFrame, name: str = "place") -> DataFrame:
    """``df`` with the number of each row in its own order, from 1: ``row_number()`` over everything, without one task for all rows.

    Rows are numbered within their partitions of the written table; only the counts of the partitions, a row each, are summed up in order.
    """
    work_folder(df.sparkSession)
    part, nth = f"__part_{uuid.uuid4().hex[:6]}", f"__nth_{uuid.uuid4().hex[:6]}"
    marked = df.withColumns({part: F.spark_partition_id(), nth: F.monotonically_increasing_id()}).checkpoint()
    counts = marked.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(part).alias("__p"), before.alias("__before"))
    placed = marked.join(offsets, F.col(part) == F.col("__p"))
    return placed.withColumn(name, F.col("__before") + F.col(nth).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(part, nth, "__p", "__before")


def json_path(column: Column, path: str) -> Column:
    """``column:path`` on a JSON string, such as ``user.tags[0]``."""
    return F.get_json_object(column, path if path.startswith("$") else ("$" if path.startswith("[") else "$.") + path)


def iff(condition: Column, then: Column, otherwise: Column) -> Column:
    return F.when(condition, then).otherwise(otherwise)


def count_distinct(*columns: Column) -> Column:
    return F.count_distinct(*columns)


def recursive_distinct(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], *, most: int = 1000) -> DataFrame:
    """``WITH RECURSIVE ... UNION``: what ``step`` makes of the newest rows, without rows already seen, until none are new.

    Rows compare null-safely on all columns.  Every round writes its new rows to the checkpoint folder;
    more than ``most`` rounds raise RecursionError.
    """
    work_folder(anchor.sparkSession)
    delta = anchor.distinct().checkpoint()
    deltas = [delta]
    names = anchor.columns
    for _ in range(most):
        every = reduce(DataFrame.unionAll, deltas)
        if not delta.take(1):
            return every
        fresh = step(delta).toDF(*names).distinct()
        same = None
        seen = every.select(*[F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(names)])
        for k, c in enumerate(names):
            term = F.col(f"`{c}`").eqNullSafe(F.col(f"__{k}"))
            same = term if same is None else same & term
        delta = fresh.join(seen, same, "left_anti").checkpoint()
        deltas.append(delta)
    raise RecursionError(f"RECURSION_LEVEL_LIMIT_EXCEEDED: more than {most} rounds")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders")


def _by_date() -> WindowSpec:
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


@R.frame("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def qualify_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return qualify(_orders(spark, sf_dir), F.row_number().over(best) <= 2).select("o_custkey", "o_orderkey")


@R.frame("SELECT o_custkey, o_orderkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 12 AND max(o_totalprice) OVER (PARTITION BY o_custkey) = o_totalprice")
def qualify_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = Window.partitionBy("o_custkey")
    return qualify(_orders(spark, sf_dir), (F.count("*").over(per) > 12) & (F.max("o_totalprice").over(per) == F.col("o_totalprice"))).select("o_custkey", "o_orderkey")


@R.frame("SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS finals, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS best FROM orders")
def window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_f = F.col("o_orderstatus") == "F"
    return _orders(spark, sf_dir).select(
        "o_orderkey",
        filtered_over(F.count, F.lit(1), is_f, _by_date()).alias("finals"),
        filtered_over(F.max, F.col("o_totalprice"), is_f, Window.partitionBy("o_custkey")).alias("best"),
    )


@R.frame("SELECT o_orderkey, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS kinds, CAST(sum(DISTINCT o_orderkey) OVER (PARTITION BY o_custkey) AS DOUBLE) AS keys FROM orders")
def window_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderpriority")
    counted = with_distinct(orders, ["o_custkey"], "o_orderpriority", count="kinds")
    return with_distinct(counted, ["o_custkey"], "o_orderkey", total="keys").select("o_orderkey", "kinds", "keys")


@R.frame("SELECT o_orderkey, median(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS mid FROM orders")
def window_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir).select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return running_median(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "mid").select("o_orderkey", "mid")


@R.frame("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY nullif(o_orderstatus, 'P') ASC NULLS LAST, o_orderkey) AS BIGINT) AS place FROM orders")
def order_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return with_place(_orders(spark, sf_dir).select("o_orderkey", "o_orderstatus").orderBy(status.asc_nulls_last(), "o_orderkey").select("o_orderkey"))


@R.frame("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", json_path(F.col("props"), "k").alias("k"))


@R.frame("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, CAST(sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS BIGINT) AS big FROM orders GROUP BY o_orderstatus")
def iff_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).groupBy("o_orderstatus").agg(
        count_distinct(F.col("o_custkey")).alias("customers"), F.sum(iff(F.col("o_totalprice") > 200000, F.lit(1), F.lit(0))).alias("big")
    )


@R.frame("WITH RECURSIVE t(a, b) AS (SELECT DISTINCT l_suppkey % 40, l_partkey % 40 FROM lineitem UNION SELECT t.a, p FROM t JOIN (SELECT DISTINCT l_suppkey % 40 AS s, l_partkey % 40 AS p FROM lineitem WHERE l_quantity > 49) l ON s = t.b) SELECT a, b FROM t")
def recursive_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which groups of parts are reached from which groups of suppliers, over hops of large quantity."""
    lines = load(spark, sf_dir, "lineitem")
    pair = [(F.col("l_suppkey") % 40).alias("s"), (F.col("l_partkey") % 40).alias("p")]
    hops = lines.filter("l_quantity > 49").select(*pair).distinct()
    return recursive_distinct(lines.select(*pair).toDF("a", "b"), lambda new: new.join(hops, F.col("b") == F.col("s")).select("a", "p"))
