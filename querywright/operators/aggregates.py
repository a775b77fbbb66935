"""Grouping, grouping sets and aggregate functions."""

from ..tables import Registry

R = Registry()

R.same(
    agg_global="SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders",
    agg_empty_input="SELECT count(*) AS n, sum(o_totalprice) AS total, max(o_orderkey) AS top FROM orders WHERE o_totalprice < 0",
    agg_group="SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM lineitem GROUP BY l_returnflag, l_linestatus",
    agg_group_expr="SELECT o_orderkey % 10 AS bucket, count(*) AS n FROM orders GROUP BY o_orderkey % 10",
    group_by_all="SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL",
    group_ordinal="SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2",
    group_alias="SELECT upper(c_mktsegment) AS seg, count(*) AS n FROM customer GROUP BY seg",
    having_alias="SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12",
    agg_filter="SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS big, count(*) AS n FROM orders GROUP BY o_orderstatus",
    agg_distinct="SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus",
    count_multi_distinct="SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) t",
    rollup="SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    cube="SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    grouping_sets="SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    max_min_by="SELECT o_custkey, max_by(o_orderkey, o_orderkey) AS top, min_by(o_totalprice, o_orderkey) AS first_price FROM orders GROUP BY o_custkey",
    count_if_agg="SELECT o_orderstatus, CAST(count_if(o_totalprice > 100000) AS BIGINT) AS big FROM orders GROUP BY o_orderstatus",
    null_group_key="SELECT nullif(o_orderstatus, 'P') AS status, count(*) AS n, count(nullif(o_orderpriority, '5-LOW')) AS known FROM orders GROUP BY nullif(o_orderstatus, 'P')",
    bool_aggs="SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_f, bool_and(o_totalprice > 1000) AS all_big FROM orders GROUP BY o_custkey",
    stddev_var="SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 6) AS vs FROM lineitem GROUP BY l_returnflag",
    corr_agg="SELECT round(corr(l_quantity, l_extendedprice), 6) AS c FROM lineitem",
    distinct_fanout="SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) GROUP BY c_mktsegment",
    aggregate_before_join="SELECT c_nationkey, CAST(sum(n) AS BIGINT) AS orders_n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey GROUP BY c_nationkey",
    repeated_aggregate="SELECT c_custkey, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    tpch_q1="SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 1) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    tpch_q3="SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10",
    tpch_q5="SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name",
    tpch_q6="SELECT round(sum(l_extendedprice * l_discount), 1) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.02 AND 0.06 AND l_quantity < 24",
)
R.pair("grouping_id", "SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS g, CAST(grouping(l_linestatus) AS BIGINT) AS gl, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS g, CAST(grouping(l_linestatus) AS BIGINT) AS gl, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
R.pair("with_rollup", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus WITH ROLLUP", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
R.pair("count_distinct_multi", "SELECT o_orderstatus, count(DISTINCT o_custkey, o_orderpriority) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(DISTINCT (o_custkey, o_orderpriority)) AS n FROM orders GROUP BY o_orderstatus")
R.pair("percentiles", "SELECT l_returnflag, median(l_quantity) AS med, percentile(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, median(l_quantity) AS med, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag")
R.pair("percentile_within_group", "SELECT l_returnflag, percentile_cont(0.25) WITHIN GROUP (ORDER BY l_extendedprice) AS p25, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity) AS d50 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS p25, quantile_disc(l_quantity, 0.5) AS d50 FROM lineitem GROUP BY l_returnflag")
R.pair("collect_sorted", "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names, CAST(size(collect_set(n_regionkey)) AS BIGINT) AS k FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, count(DISTINCT n_regionkey) AS k FROM nation GROUP BY n_regionkey")
R.pair("listagg_within_group", "SELECT conv_id, listagg(role, '>') WITHIN GROUP (ORDER BY turn) AS roles FROM conversations GROUP BY conv_id", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
R.pair("any_value_ignore_nulls", "SELECT n_regionkey, any_value(n_regionkey) IGNORE NULLS AS k FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, any_value(n_regionkey) AS k FROM nation GROUP BY n_regionkey")
R.pair(
    "approx_functions",  # the exact count stands apart: beside a DISTINCT every customer of a status would carry sketches of its own
    "WITH sketched AS (SELECT o_orderstatus, approx_count_distinct(o_custkey) AS about, percentile_approx(o_totalprice, 0.5) AS middle, percentile(o_totalprice, 0.5) AS median FROM orders GROUP BY o_orderstatus), counted AS (SELECT o_orderstatus AS status, count(o_custkey) AS n FROM (SELECT DISTINCT o_orderstatus, o_custkey FROM orders) pairs GROUP BY o_orderstatus) SELECT o_orderstatus, abs(about - n) <= 0.2 * n AS near, abs(middle - median) <= 0.05 * median AS mid FROM sketched JOIN counted ON o_orderstatus <=> status",
    "SELECT o_orderstatus, TRUE AS near, TRUE AS mid FROM orders GROUP BY o_orderstatus",
)
R.pair("first_last", "SELECT o_custkey, max(struct(o_orderdate, o_orderkey)).o_orderkey AS newest, min(struct(o_orderdate, o_orderkey)).o_orderkey AS oldest FROM orders GROUP BY o_custkey", "SELECT o_custkey, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS newest, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS oldest FROM orders GROUP BY o_custkey")
