"""Window functions."""

from ..tables import Registry

R = Registry()
_O = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"

R.same(
    row_number=f"SELECT o_orderkey, CAST(row_number() OVER ({_O}) AS BIGINT) AS rn FROM orders",
    rank_dense_rank="SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr FROM orders",
    percent_rank_cume_dist="SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice), 9) AS pr, round(cume_dist() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice), 9) AS cd FROM orders",
    ntile=f"SELECT o_orderkey, CAST(ntile(4) OVER ({_O}) AS BIGINT) AS q FROM orders",
    lag_lead_default=f"SELECT o_orderkey, lag(o_totalprice, 1, 0.0) OVER ({_O}) AS prev, lead(o_orderkey, 2) OVER ({_O}) AS next2 FROM orders",
    running_sum_rows=f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running FROM orders",
    moving_avg_rows=f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER ({_O} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS DOUBLE) / count(*) OVER ({_O} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS moving FROM orders",
    range_peers="SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS upto FROM orders",
    range_offset_frame="SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS near FROM orders",
    whole_partition_share="SELECT c_custkey, round(c_acctbal / sum(abs(c_acctbal)) OVER (PARTITION BY c_mktsegment), 9) AS share FROM customer",
    window_on_agg="SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS of_status FROM orders GROUP BY o_orderstatus, o_orderpriority",
    named_window="SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(count(*) OVER w AS BIGINT) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    first_last_nth=f"SELECT o_orderkey, first_value(o_orderkey) OVER ({_O}) AS f, last_value(o_orderkey) OVER ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER ({_O}) AS second FROM orders",
    sessions="SELECT event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM (SELECT event_id, user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL '6' HOUR THEN 0 ELSE 1 END AS fresh FROM events) t",
    turn_change="SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prior_role FROM conversations",
)
R.pair("lag_ignore_nulls", f"SELECT o_orderkey, lag(nullif(o_orderstatus, 'P')) IGNORE NULLS OVER ({_O}) AS known FROM orders", f"SELECT o_orderkey, lag(nullif(o_orderstatus, 'P') IGNORE NULLS) OVER ({_O}) AS known FROM orders")
R.pair("gaps_islands",
    "SELECT user_id, min(d) AS first_day, max(d) AS last_day, count(*) AS days FROM (SELECT user_id, d, date_sub(d, CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INT)) AS island FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events) e) t GROUP BY user_id, island",
    "SELECT user_id, min(d) AS first_day, max(d) AS last_day, count(*) AS days FROM (SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS island FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events) e) t GROUP BY user_id, island")
