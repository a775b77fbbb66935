"""Slow and fast forms of the same question, and a check that they agree.

Each pair asks one thing twice: as it is often written first, and in the form that scans less, joins less or
pushes its filter into the scan.  ``grade`` compares results and the work that Spark measured.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.extras import with_place
from ..tables import Registry
from .executed import Work, work

R = Registry()


def _normal(df: DataFrame, digits: int) -> DataFrame:
    columns = []
    for k, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`") if df.columns.count(f.name) == 1 else df[k]
        kind = f.dataType.typeName()
        if kind in ("double", "float", "decimal", "integer", "long", "short", "byte"):
            c = F.round(c.cast("double"), digits).cast("string")
        elif kind in ("array", "map", "struct"):
            c = F.to_json(c)
        else:
            c = c.cast("string")
        columns.append(c.alias(f"c{k}"))
    return df.select(*columns)


def same_rows(a: DataFrame, b: DataFrame, *, digits: int = 4, ordered: bool = False) -> bool:
    """Whether two results hold the same rows as often (``ordered``: at the same places), numbers to ``digits`` places, whatever their names."""
    if len(a.columns) != len(b.columns):
        return False
    x, y = _normal(a, digits), _normal(b, digits)
    if ordered:
        x, y = with_place(x), with_place(y)
    counted = x.withColumn("__n", F.lit(1)).unionAll(y.withColumn("__n", F.lit(-1)))
    return not counted.groupBy(*x.columns).agg(F.sum("__n").alias("n")).filter("n <> 0").take(1)


@dataclass(frozen=True)
class Verdict:
    passed: bool
    same: bool
    slow: Work
    fast: Work


def grade(slow: DataFrame, fast: DataFrame, *, target: float = 1.0, ordered: bool = False) -> Verdict:
    """Passed: the same rows (in the same order, where that counts), with operators that put out at most ``target`` of the rows."""
    same = same_rows(slow, fast, ordered=ordered)
    a, b = work(slow), work(fast)
    return Verdict(same and b.rows <= target * a.rows, same, a, b)


#: Pairs whose rows have an order, and the share of rows that the fast form of a pair may put out where it is not all.
ORDERED = ("offset_page",)
TARGETS = {"running_total": 0.2, "newest_per_group": 0.8, "rank_by_count": 0.8}


PAIRS: dict[str, tuple[str, str]] = {
    "function_on_column": (
        "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1997",
        "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'",
    ),
    "arithmetic_on_column": ("SELECT o_orderkey FROM orders WHERE o_totalprice * 2 > 800000", "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000"),
    "cast_to_date": (
        "SELECT event_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05'",
        "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'",
    ),
    "implicit_cast": ("SELECT c_name FROM customer WHERE CAST(c_custkey AS VARCHAR(20)) = '77'", "SELECT c_name FROM customer WHERE c_custkey = 77"),
    "lower_on_column": ("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "n_plus_one": (
        "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer",
        "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey",
    ),
    "newest_per_group": (
        "SELECT o_custkey, o_orderkey FROM orders a WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders b WHERE b.o_custkey = a.o_custkey)",
        "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey",
    ),
    "running_total": (
        "SELECT a.o_orderkey, CAST(sum(CAST(b.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS running FROM orders a JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderkey <= a.o_orderkey GROUP BY a.o_orderkey",
        "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS DOUBLE) AS running FROM orders",
    ),
    "fanout_distinct": (
        "SELECT DISTINCT c_custkey FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 45",
        "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45))",
    ),
    "count_for_existence": (
        "SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) > 0",
        "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    ),
    "aggregate_late": (
        "SELECT c_nationkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey",
        "SELECT c_nationkey, CAST(sum(n) AS BIGINT) AS n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey GROUP BY c_nationkey",
    ),
    "rank_by_count": (
        "SELECT a.s_suppkey FROM supplier a WHERE (SELECT count(*) FROM supplier b WHERE b.s_nationkey = a.s_nationkey AND (b.s_acctbal > a.s_acctbal OR (b.s_acctbal = a.s_acctbal AND b.s_suppkey < a.s_suppkey))) < 2",
        "SELECT s_suppkey FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM supplier) t WHERE rn <= 2",
    ),
    "offset_page": (
        "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 1000",
        "SELECT o_orderkey FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1000) page) ORDER BY o_orderkey LIMIT 50",
    ),
    "report": (
        "SELECT r_name, (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS customers, (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS suppliers FROM region",
        "SELECT r_name, c.n AS customers, s.n AS suppliers FROM region JOIN (SELECT n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey) c ON c.n_regionkey = r_regionkey JOIN (SELECT n_regionkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey) s ON s.n_regionkey = r_regionkey",
    ),
}

#: Slow forms that compare all pairs of a group are registered as a count over the window's rows instead, which grows with the
#: rows and still ranks all of them; ``PAIRS`` keeps the text that is graded.
COUNTED = {
    "rank_by_count": "SELECT s_suppkey FROM (SELECT s_suppkey, count(*) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM supplier) t WHERE before < 2",
}

for _name, (_slow, _fast) in PAIRS.items():
    R.pair(f"slow_{_name}", COUNTED.get(_name, _slow), _fast)
    R.pair(f"fast_{_name}", _fast, _slow)
