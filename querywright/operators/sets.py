"""Set operations, CTEs and recursion."""

from ..tables import Registry

R = Registry()
_F, _U = "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'", "SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'"

R.same(
    union_all=f"{_F} UNION ALL {_U}",
    union_distinct=f"{_F} UNION {_U}",
    intersect=f"{_F} INTERSECT {_U}",
    intersect_all=f"{_F} INTERSECT ALL {_U}",
    except_distinct=f"SELECT c_custkey AS k FROM customer EXCEPT ({_U})",
    except_all=f"{_F} EXCEPT ALL {_U}",
    setop_precedence=f"SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region INTERSECT SELECT n_nationkey FROM nation",
    or_to_union="SELECT o_orderkey FROM orders WHERE o_custkey = 7 UNION SELECT o_orderkey FROM orders WHERE o_totalprice > 400000",
    setop_order_limit="SELECT n_name AS name FROM nation UNION SELECT r_name FROM region ORDER BY name LIMIT 10",
    cte_chain="WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM per JOIN customer ON c_custkey = o_custkey",
    cte_columns="WITH t(k, n) AS (SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey) SELECT k, n FROM t WHERE n > 10",
    cte_reuse="WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.o_custkey FROM t a WHERE a.n = (SELECT max(n) FROM t)",
    recursive_numbers="WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT CAST(n AS BIGINT) AS n FROM t JOIN region ON r_regionkey = n % 5",
)
R.pair(
    "recursive_hierarchy",
    "WITH RECURSIVE up(k, top, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT k, top DIV 2, depth + 1 FROM up WHERE top > 0) SELECT k, CAST(max(depth) AS BIGINT) AS depth FROM (SELECT k, depth FROM up LIMIT ALL) whole GROUP BY k",
    "WITH RECURSIVE up(k, top, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT k, top // 2, depth + 1 FROM up WHERE top > 0) SELECT k, CAST(max(depth) AS BIGINT) AS depth FROM up GROUP BY k",
)
