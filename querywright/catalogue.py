"""All registered queries of the library, by name, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import more, nested, scalars
from .operators import aggregates, extras, filters, joins, sets, windows
from .plans import projections, rewrites
from .sources import changes, files
from .streaming import events
from .tables import Query, Registry, load

R = Registry()


@R.frame("""
SELECT c_mktsegment, count(*) AS customers, CAST(sum(n) AS BIGINT) AS orders, CAST(sum(spent) AS DOUBLE) AS revenue
FROM customer JOIN (SELECT o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS spent
                    FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey
GROUP BY c_mktsegment
""")
def flagship_segment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are summed by customer before the join, so the join carries a row a customer."""
    orders, customer = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    spent = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent"))
    joined = customer.join(spent, customer["c_custkey"] == spent["o_custkey"])
    return joined.groupBy("c_mktsegment").agg(
        F.count("*").alias("customers"), F.sum("n").alias("orders"), F.sum("spent").cast("double").alias("revenue")
    )


_ALL = [R, *(m.R for m in (filters, joins, aggregates, windows, sets, scalars, nested, more, extras, changes, projections, rewrites, files, events))]


def queries() -> dict[str, Query]:
    return {name: query for r in _ALL for name, query in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for r in _ALL for name, text in r.twins.items()}
