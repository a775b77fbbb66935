"""Scans, projections, predicates, sorting and limits."""

from ..tables import Registry

R = Registry()

R.same(
    scan_project="SELECT c_custkey, c_name, c_mktsegment FROM customer",
    filter_and_or_not="SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND NOT (o_totalprice < 50000)",
    filter_between="SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000",
    filter_in_list="SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    filter_like="SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ing%' AND p_name NOT LIKE 'red%'",
    filter_like_prefix="SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#00000001%'",
    filter_ilike="SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ILIKE 'build%'",
    filter_range_halfopen="SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'",
    is_null_distinct_from="SELECT o_orderkey, nullif(o_orderstatus, 'P') IS NULL AS no_status, nullif(o_orderstatus, 'P') IS DISTINCT FROM 'F' AS other FROM orders",
    is_true_false="SELECT o_orderkey, (nullif(o_orderstatus, 'P') = 'F') IS TRUE AS is_f, (nullif(o_orderstatus, 'P') = 'F') IS NOT FALSE AS not_false FROM orders",
    three_valued_logic="SELECT count(*) AS n FROM orders WHERE nullif(o_orderstatus, 'P') <> 'F' OR (nullif(o_orderstatus, 'P') = 'O' AND o_totalprice > 0)",
    case_searched="SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS size_class FROM orders",
    case_simple="SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS status_name FROM orders",
    select_distinct="SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    values_inline="SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b) JOIN region ON r_regionkey = a",
    lateral_alias="SELECT l_orderkey, l_linenumber, l_extendedprice * 2 AS doubled, doubled + 1 AS more FROM lineitem",
    derived_table="SELECT seg, n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) t(seg, n) WHERE n > 10",
    arithmetic="SELECT l_orderkey, l_linenumber, l_quantity / 4 AS q4, CAST(l_quantity AS BIGINT) % 7 AS m7, -l_quantity AS neg FROM lineitem",
    concat_operator="SELECT c_custkey, c_name || '/' || c_mktsegment AS label FROM customer",
    order_limit="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    limit_offset="SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 100",
    keyset_page="SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 50",
    topn_per_group="SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3",
    latest_per_group="SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) t WHERE rn = 1",
)
R.pair("star_except", "SELECT * EXCEPT (n_regionkey) FROM nation", "SELECT * EXCLUDE (n_regionkey) FROM nation")
R.pair("qualified_star", "SELECT n.*, r_name FROM nation n JOIN region r ON n_regionkey = r_regionkey", "SELECT n.*, r_name FROM nation n JOIN region r ON n_regionkey = r_regionkey")
R.pair("null_safe_eq", "SELECT o_orderkey, nullif(o_orderstatus, 'P') <=> nullif(o_orderstatus, 'O') AS same FROM orders", "SELECT o_orderkey, nullif(o_orderstatus, 'P') IS NOT DISTINCT FROM nullif(o_orderstatus, 'O') AS same FROM orders")
R.pair("filter_rlike", "SELECT s_suppkey, s_name FROM supplier WHERE s_name RLIKE '[02468]$'", "SELECT s_suppkey, s_name FROM supplier WHERE regexp_matches(s_name, '[02468]$')")
R.pair("like_any_all", "SELECT p_partkey FROM part WHERE p_name LIKE ANY ('red%', 'blue%') AND p_name LIKE ALL ('%i%', '%t%')", "SELECT p_partkey FROM part WHERE (p_name LIKE 'red%' OR p_name LIKE 'blue%') AND (p_name LIKE '%i%' AND p_name LIKE '%t%')")
R.pair("integer_division", "SELECT o_orderkey, o_orderkey DIV 7 AS d, o_orderkey & 6 AS a, o_orderkey | 1 AS o, o_orderkey ^ 3 AS x, ~o_orderkey AS inv FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS d, o_orderkey & 6 AS a, o_orderkey | 1 AS o, xor(o_orderkey, 3) AS x, ~o_orderkey AS inv FROM orders")
R.pair("range_tvf", "SELECT r.id AS k, n_name FROM range(0, 25, 3) r JOIN nation ON n_nationkey = r.id", "SELECT r.range AS k, n_name FROM range(0, 25, 3) r JOIN nation ON n_nationkey = r.range")
R.pair("interval_arithmetic", "SELECT o_orderkey, o_orderdate + INTERVAL 3 MONTH AS later, o_orderdate - INTERVAL 10 DAY AS earlier FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 3 MONTH AS later, o_orderdate - INTERVAL 10 DAY AS earlier FROM orders")
