"""Row changes as new versions of a table: insert, update, delete and merge over DataFrames.

Parquet tables have no row-level changes, so a change is the DataFrame of the next version; ``write_version``
puts it beside the old one, never over files being read.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Registry, load, work_folder

R = Registry()


def _same_type(df: DataFrame, like: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    cast = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in like.schema])
    for c in required:
        failed = F.concat(F.lit("NOT_NULL_CONSTRAINT_VIOLATION: "), F.lit(c))
        cast = cast.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(failed).cast(like.schema[c].dataType)).otherwise(F.col(c)))
    return cast


def insert(table: DataFrame, rows: DataFrame, columns: Sequence[str] | None = None, *, required: Sequence[str] = (), overwrite: bool = False) -> DataFrame:
    """Rows cast to the table's types; columns not named are null; a null in a ``required`` column raises."""
    names = list(columns or table.columns)
    if len(names) != len(rows.columns):
        raise ValueError(f"INSERT_COLUMN_ARITY_MISMATCH: {len(names)} columns, {len(rows.columns)} values")
    named = rows.toDF(*names)
    full = named.select(*[F.col(f"`{c}`") if c in names else F.lit(None).alias(c) for c in table.columns])
    fresh = _same_type(full, table, required)
    return fresh if overwrite else table.unionByName(fresh)


def update(table: DataFrame, assign: Mapping[str, Column], where: Column | None = None, *, required: Sequence[str] = ()) -> DataFrame:
    """All assignments read the old row; rows where the condition is null stay."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    changed = table.select(*[F.when(hit, assign[c].cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in assign else F.col(c) for c in table.columns])
    return _same_type(changed, table, required)


def delete(table: DataFrame, where: Column | None = None) -> DataFrame:
    """Rows where the condition is true go; null keeps."""
    return table.filter(~F.coalesce(where, F.lit(False))) if where is not None else table.limit(0)


@dataclass
class Clause:
    """One WHEN clause: ``action`` is update, delete or insert; ``assign`` of an update or insert defaults to all columns."""

    action: str
    when: Column | None = None
    assign: Mapping[str, Column] | None = None


@dataclass
class Merge:
    """``MERGE INTO target USING source ON keys``; the sides are read as ``t.column`` and ``s.column``.

    The first clause of a kind that applies wins, and rows that none applies to stay as they are.  A target
    row that two source rows match raises where any matched clause is given.
    """

    matched: Sequence[Clause] = field(default_factory=tuple)
    not_matched: Sequence[Clause] = field(default_factory=tuple)
    not_matched_by_source: Sequence[Clause] = field(default_factory=tuple)


def merge(target: DataFrame, source: DataFrame, on: Column, plan: Merge, *, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The next version and a one-row DataFrame of counts (updated, deleted, inserted)."""
    work_folder(target.sparkSession)
    t = target.withColumns({"__row": F.monotonically_increasing_id(), "__in_t": F.lit(True)}).alias("t")
    s = source.withColumn("__in_s", F.lit(True)).alias("s")
    side = lambda name, columns: F.struct(*[F.col(f"{name}.`{c}`") for c in columns]).alias(name)
    # The sides are read and joined once; the check and the result both come from the written join.
    joined = t.join(s, on, "full").select(side("t", target.columns), side("s", source.columns), "__row", "__in_t", "__in_s").checkpoint()
    if plan.matched and joined.filter("__in_t AND __in_s").groupBy("__row").count().filter("count > 1").take(1):
        raise ValueError("MERGE_CARDINALITY_VIOLATION: more than one source row matches a target row")
    in_t, in_s = F.coalesce("__in_t", F.lit(False)), F.coalesce("__in_s", F.lit(False))
    cases = [(in_t & in_s, plan.matched), (in_s & ~in_t, plan.not_matched), (in_t & ~in_s, plan.not_matched_by_source)]

    chosen = F.when(F.lit(False), F.lit(""))
    labels: list[tuple[str, Clause]] = []
    for state, clauses in cases:
        for clause in clauses:
            label = f"{len(labels)}:{clause.action}"
            labels.append((label, clause))
            chosen = chosen.when(state & (F.coalesce(clause.when, F.lit(False)) if clause.when is not None else F.lit(True)), label)
    acted = joined.withColumn("__act", chosen.otherwise(F.when(in_t, "keep").otherwise("none")))

    def value(c: str) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast(target.schema[c].dataType))
        for label, clause in labels:
            if clause.action == "delete":
                continue
            new = (clause.assign or {}).get(c) if clause.assign is not None else F.col(f"s.{c}")
            if new is None:
                new = F.col(f"t.{c}") if clause.action == "update" else F.lit(None)
            out = out.when(F.col("__act") == label, new.cast(target.schema[c].dataType))
        return out.otherwise(F.col(f"t.{c}")).alias(c)

    result = acted.filter((F.col("__act") != "none") & ~F.col("__act").endswith(":delete")).select(*[value(c) for c in target.columns])
    count = lambda action: F.count_if(F.col("__act").endswith(f":{action}"))
    counts = acted.agg(count("update").alias("num_updated_rows"), count("delete").alias("num_deleted_rows"), count("insert").alias("num_inserted_rows"))
    return _same_type(result, target, required), counts


def write_version(df: DataFrame, base: str) -> DataFrame:
    """Writes the next version under ``base`` in a folder of its own and reads it back."""
    path = f"{base.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@R.frame("SELECT * FROM nation UNION ALL SELECT 100 + r_regionkey, r_name, NULL FROM region")
def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("k"), "r_name")
    return insert(load(spark, sf_dir, "nation"), rows, ["n_nationkey", "n_name"])


@R.frame("SELECT r_regionkey AS n_nationkey, r_name AS n_name, r_regionkey AS n_regionkey FROM region")
def dml_insert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "region").selectExpr("r_regionkey", "r_name", "r_regionkey AS again")
    return insert(load(spark, sf_dir, "nation"), rows, overwrite=True)


@R.frame("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return update(customer, {"c_acctbal": F.lit(0.0), "c_mktsegment": F.lit("DEBT")}, F.col("c_acctbal") < 0)


@R.frame("SELECT * FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'P') = 'F', FALSE)")
def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delete(load(spark, sf_dir, "orders"), F.nullif(F.col("o_orderstatus"), F.lit("P")) == "F")


_MERGED = """
SELECT coalesce(t.k, s.k) AS k, CASE WHEN t.k IS NULL THEN s.v WHEN s.k IS NULL THEN t.v WHEN s.v > t.v THEN s.v ELSE t.v END AS v
FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer) t
FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) s ON t.k = s.k
WHERE NOT (t.k IS NOT NULL AND s.k IS NOT NULL AND t.v < 0) AND NOT (s.k IS NULL AND t.v < 100)
"""


@R.frame(_MERGED)
def dml_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = load(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_acctbal AS v")
    source = load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    plan = Merge(
        matched=[Clause("delete", F.col("t.v") < 0), Clause("update", F.col("s.v") > F.col("t.v"), {"v": F.col("s.v")})],
        not_matched=[Clause("insert")],
        not_matched_by_source=[Clause("delete", F.col("t.v") < 100)],
    )
    return merge(target, source, F.col("t.k") == F.col("s.k"), plan)[0]


@R.frame("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def ctas_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE AS: the query's rows written as a version and read back."""
    made = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return write_version(made, f"{work_folder(spark)}/ctas")
