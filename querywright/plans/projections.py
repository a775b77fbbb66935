"""Sorted projections: what an index is on a columnar lake.

A projection holds some columns of a table (keys, included columns), perhaps only the rows of a predicate,
range-partitioned and sorted by the keys.  Parquet's row-group statistics then let a scan with a bound
on the leading key skip most of it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Registry, load, work_folder
from .executed import scans

R = Registry()


@dataclass(frozen=True)
class Projection:
    """A written projection and what it was made from."""

    name: str
    table: str
    keys: tuple[str, ...]
    include: tuple[str, ...]
    where: str | None
    path: str

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def covers(self, columns: Sequence[str], where: str | None = None) -> bool:
        """Whether a query that needs ``columns`` and repeats ``where`` can be answered from it."""
        return set(columns) <= {*self.keys, *self.include} and (self.where is None or self.where == where)


class Registrar:
    """The projections of a set of tables, by name."""

    def __init__(self, base: str):
        self.base = base.rstrip("/")
        self.known: dict[str, Projection] = {}

    def create(self, df: DataFrame, name: str, table: str, keys: Sequence[str], *, include: Sequence[str] = (), where: str | None = None, unique: bool = False, parts: int | None = None) -> Projection:
        """Writes a projection; with ``unique`` equal keys without nulls raise."""
        if name in self.known:
            raise ValueError(f"INDEX_ALREADY_EXISTS: {name}")
        rows = (df.filter(where) if where else df).select(*dict.fromkeys([*keys, *include]))
        if unique:
            known = rows.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
            if known.groupBy(*keys).count().filter("count > 1").take(1):
                raise ValueError(f"UNIQUE_CONSTRAINT_VIOLATION: {name} on {', '.join(keys)}")
        sized = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
        path = f"{self.base}/{name}"
        sized.sortWithinPartitions(*keys).write.parquet(path)
        self.known[name] = Projection(name, table, tuple(keys), tuple(include), where, path)
        return self.known[name]

    def drop(self, name: str) -> None:
        if name not in self.known:
            raise KeyError(f"INDEX_NOT_FOUND: {name}")
        del self.known[name]


def skipping_report(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """For each named predicate whether file statistics can skip rows by it, read off the plan's pushed filters.

    ``why`` not: NOT_PUSHED, the scan gets no test of the column (a function, a cast, a pattern without a fixed start); or
    NO_RANGE, it gets one that bounds no single column (alternatives, inequality, a fixed end).
    """
    rows = []
    for name, condition in conditions.items():
        pushed = " ".join(x["pushed"] for x in scans(df.filter(condition)))
        tests = re.findall(r"\b(\w+)\(", pushed)
        helps = any(t in ("EqualTo", "EqualNullSafe", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "In", "StringStartsWith", "IsNull") for t in tests) and "Or" not in tests
        why = None if helps else "NOT_PUSHED" if set(tests) <= {"IsNotNull"} else "NO_RANGE"
        rows.append((name, helps, pushed, why))
    return df.sparkSession.createDataFrame(rows, "predicate string, skips boolean, pushed string, why string")


def _bench(spark: SparkSession) -> Registrar:
    return Registrar(f"{work_folder(spark)}/projections-{uuid.uuid4().hex}")


@R.frame("SELECT o_custkey, o_orderdate, o_totalprice FROM orders WHERE o_custkey BETWEEN 100 AND 120")
def projection_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A covering projection on (customer, date) answers the range."""
    kept = _bench(spark)
    made = kept.create(load(spark, sf_dir, "orders"), "by_customer", "orders", ["o_custkey", "o_orderdate"], include=["o_totalprice"])
    return made.read(spark).filter(F.col("o_custkey").between(100, 120))


@R.frame("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '2001-01-01'")
def projection_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partial projection of pending orders."""
    kept = _bench(spark)
    made = kept.create(load(spark, sf_dir, "orders"), "pending", "orders", ["o_orderdate"], include=["o_orderkey"], where="o_orderstatus = 'P'")
    return made.read(spark).filter("o_orderdate >= TIMESTAMP_NTZ'2001-01-01'").select("o_orderkey", "o_orderdate")
