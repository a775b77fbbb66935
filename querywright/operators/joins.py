"""Joins of every kind, and subqueries that become joins."""

from ..tables import Registry

R = Registry()

R.same(
    join_inner="SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    join_left="SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') o ON c_custkey = o_custkey",
    join_right="SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') o RIGHT JOIN customer ON c_custkey = o_custkey",
    join_full="SELECT a.o_orderkey AS ka, b.o_orderkey AS kb FROM (SELECT * FROM orders WHERE o_totalprice > 300000) a FULL OUTER JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') b ON a.o_orderkey = b.o_orderkey",
    join_semi="SELECT c_custkey, c_name FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey",
    join_anti="SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey",
    join_cross="SELECT r_name, n_name FROM region CROSS JOIN nation",
    join_comma="SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey",
    join_using="SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) n JOIN (SELECT r_regionkey AS k, r_name FROM region) r USING (k)",
    join_full_using="SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation WHERE n_nationkey < 15) x FULL JOIN (SELECT n_nationkey AS k, n_name AS b FROM nation WHERE n_nationkey > 10) y USING (k)",
    join_natural="SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) n NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) r",
    join_self="SELECT a.n_name AS first_name, b.n_name AS second_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    join_theta="SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey > b.n_nationkey + 20",
    join_range="SELECT e.event_id, b.name FROM events e JOIN (VALUES ('low', 0.0, 20.0), ('mid', 20.0, 60.0), ('high', 60.0, 1000000.0)) AS b(name, lo, hi) ON e.value >= b.lo AND e.value < b.hi",
    join_equi_residual="SELECT o_orderkey, l_linenumber, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice / 3",
    join_multi_key="SELECT s_suppkey, count(*) AS n, max(c_custkey) AS newest FROM supplier JOIN customer ON s_nationkey = c_nationkey AND floor(s_acctbal / 1000) = floor(c_acctbal / 1000) GROUP BY s_suppkey",
    join_fanout="SELECT c_mktsegment, count(DISTINCT o_orderkey) AS orders_n, count(*) AS lines_n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_mktsegment",
    join_sparse_left="SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    lateral_left="SELECT n_name, t.top FROM nation LEFT JOIN LATERAL (SELECT max(s_acctbal) AS top FROM supplier WHERE s_nationkey = n_nationkey) t ON TRUE",
    scalar_subquery="SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) * 0.9 FROM orders)",
    scalar_correlated="SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS best FROM customer",
    in_subquery="SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    not_in_subquery="SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    not_in_null="SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 5) FROM orders)",
    exists_semi="SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)",
    not_exists_anti="SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)",
    exists_in_select="SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') AS returned FROM orders o",
    having_subquery="SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > (SELECT avg(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) t)",
)
R.pair(
    "lateral_topn",  # ORDER BY with LIMIT in a correlated LATERAL becomes a sort, an exchange and a row_number() without an order: the exchange keeps none
    "SELECT c_custkey, t.o_orderkey FROM customer JOIN LATERAL (SELECT o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey NULLS LAST) AS place FROM orders) ranked WHERE o_custkey = c_custkey AND place <= 2) t ON TRUE",
    "SELECT c_custkey, t.o_orderkey FROM customer JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t ON TRUE",
)
R.pair(
    "scalar_correlated_noneq",  # suppliers that are richer come before in the rank, so no pairs of a nation are compared; nothing is richer than null
    "SELECT s_suppkey, CASE WHEN s_nationkey IS NULL OR s_acctbal IS NULL THEN 0L ELSE rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC NULLS LAST) - 1L END AS richer FROM supplier",
    "SELECT s_suppkey, (SELECT count(*) FROM supplier b WHERE b.s_nationkey = a.s_nationkey AND b.s_acctbal > a.s_acctbal) AS richer FROM supplier a",
)
R.pair(
    "asof_rewrite",  # the newest earlier click of the user: one pass in time order, no join of all earlier ones
    "SELECT event_id, user_id, prior.event_id AS prior_id FROM (SELECT event_id, user_id, event_type, max(CASE WHEN event_type = 'click' THEN named_struct('ts', ts, 'event_id', event_id) END) OVER (PARTITION BY user_id ORDER BY unix_micros(CAST(ts AS TIMESTAMP)) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM events) WHERE event_type = 'purchase' AND prior IS NOT NULL",
    "SELECT event_id, user_id, prior_id FROM (SELECT e.event_id, e.user_id, p.event_id AS prior_id, row_number() OVER (PARTITION BY e.event_id ORDER BY p.ts DESC, p.event_id DESC) AS rn FROM events e JOIN events p ON e.user_id = p.user_id AND p.event_type = 'click' AND p.ts < e.ts WHERE e.event_type = 'purchase') t WHERE rn = 1",
)
