"""The remaining names of the function families: aliases, outer generators, time construction, string search."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..tables import Registry, load

R = Registry()

R.same(
    like_escape="SELECT p_partkey, p_brand LIKE 'Brand##1%' ESCAPE '#' AS e, p_name LIKE '%!_%' ESCAPE '!' AS u FROM part",
    outer_aliases="SELECT o_orderpriority, round(variance(o_totalprice) / 1000000, 3) AS va, round(stddev(o_totalprice), 3) AS sd, bool_or(o_totalprice > 400000) AS bo FROM orders GROUP BY o_orderpriority",
    unary_precedence="SELECT l_orderkey, l_linenumber, -l_linenumber + +2 AS a, - (l_linenumber * 2) AS b, NOT l_linenumber > 2 AND l_linenumber < 6 AS c, 1 + l_linenumber * 2 AS d FROM lineitem",
    lateral_semi="SELECT c_custkey FROM customer c WHERE EXISTS (SELECT o_custkey FROM orders o WHERE o.o_custkey = c.c_custkey GROUP BY o_custkey HAVING count(*) > 8)",
    lateral_anti="SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT o_custkey FROM orders o WHERE o.o_custkey = c.c_custkey GROUP BY o_custkey HAVING count(*) > 8)",
)
R.pair(
    "bitwise",
    "SELECT l_orderkey, l_linenumber, l_orderkey & 12 | 3 AS a, (l_orderkey ^ l_linenumber) & 255 AS x, ~l_linenumber AS n, (l_orderkey & 7) || '!' AS mixed FROM lineitem",
    "SELECT l_orderkey, l_linenumber, (l_orderkey & 12) | 3 AS a, xor(l_orderkey, l_linenumber) & 255 AS x, ~l_linenumber AS n, CAST(l_orderkey & 7 AS VARCHAR) || '!' AS mixed FROM lineitem",
)
R.pair("minus", "SELECT c_custkey FROM customer MINUS SELECT o_custkey FROM orders", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
R.pair("fn_null_tests", "SELECT c_custkey, isnull(nullif(c_nationkey, 3)) AS a, isnotnull(nullif(c_nationkey, 3)) AS b FROM customer", "SELECT c_custkey, nullif(c_nationkey, 3) IS NULL AS a, nullif(c_nationkey, 3) IS NOT NULL AS b FROM customer")
R.pair(
    "fn_string_aliases",
    "SELECT p_partkey, CAST(char_length(p_name) AS BIGINT) AS cl, CAST(character_length(p_name) AS BIGINT) AS chl, startswith(p_name, 'c') AS sw, endswith(p_name, 't') AS ew, ucase(p_name) AS uc, lcase(p_type) AS lc, substr(p_name, 2, 3) AS ss, CAST(locate('t', p_name) AS BIGINT) AS lo, CAST(position('t' IN p_name) AS BIGINT) AS po, regexp_substr(p_brand, '[0-9]+') AS rs, regexp_substr(p_name, '[0-9]+') AS none, char(65 + p_size % 26) AS ch FROM part",
    "SELECT p_partkey, length(p_name) AS cl, length(p_name) AS chl, starts_with(p_name, 'c') AS sw, suffix(p_name, 't') AS ew, upper(p_name) AS uc, lower(p_type) AS lc, substring(p_name, 2, 3) AS ss, CAST(instr(p_name, 't') AS BIGINT) AS lo, CAST(instr(p_name, 't') AS BIGINT) AS po, regexp_extract(p_brand, '[0-9]+') AS rs, CAST(NULL AS VARCHAR) AS none, chr(65 + p_size % 26) AS ch FROM part",
)
R.pair(
    "fn_math_aliases",  # the sum is held against the range of INT first: try_add throws and catches an exception for every overflow
    "SELECT l_orderkey, l_linenumber, CAST(ceiling(l_extendedprice) AS BIGINT) AS c, round(pow(l_quantity, 2), 6) AS pw, round(log(l_extendedprice), 9) AS l1, round(log(2, l_quantity), 9) AS l2, CAST(signum(l_discount - 0.05) AS DOUBLE) AS sg, try_add(l_quantity, l_tax) AS ta, try_subtract(l_quantity, l_tax) AS ts, try_multiply(l_quantity, l_tax) AS tm, CASE WHEN l_orderkey BETWEEN -4294966648 AND 647 THEN CAST(try_add(l_orderkey, 2147483000L) AS INT) END AS over FROM lineitem",
    "SELECT l_orderkey, l_linenumber, CAST(ceil(l_extendedprice) AS BIGINT) AS c, round(pow(l_quantity, 2), 6) AS pw, round(ln(l_extendedprice), 9) AS l1, round(log2(l_quantity), 9) AS l2, CAST(sign(l_discount - 0.05) AS DOUBLE) AS sg, l_quantity + l_tax AS ta, l_quantity - l_tax AS ts, l_quantity * l_tax AS tm, TRY_CAST(CAST(l_orderkey AS BIGINT) + 2147483000 AS INTEGER) AS over FROM lineitem",
)
R.pair(
    "fn_time_parts",
    "SELECT event_id, CAST(minute(ts) AS BIGINT) AS mi, CAST(second(ts) AS BIGINT) AS se, CAST(dayofmonth(ts) AS BIGINT) AS dm, CAST(date_part('HOUR', ts) AS BIGINT) AS dh, CAST(date_diff(DATE'2030-01-01', CAST(ts AS DATE)) AS BIGINT) AS dd, CAST(timestampdiff(HOUR, ts, TIMESTAMP_NTZ'2030-01-01 00:00:00') AS BIGINT) AS td, CAST(dateadd(DAY, 3, ts) AS DATE) AS da FROM events",
    "SELECT event_id, minute(ts) AS mi, second(ts) AS se, day(ts) AS dm, hour(ts) AS dh, date_diff('day', CAST(ts AS DATE), DATE '2030-01-01') AS dd, CAST(floor((epoch(TIMESTAMP '2030-01-01') - epoch(ts)) / 3600) AS BIGINT) AS td, CAST(ts + INTERVAL 3 DAY AS DATE) AS da FROM events",
)
R.pair(
    "fn_time_text",
    "SELECT event_id, unix_timestamp(to_timestamp(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), 'yyyy-MM-dd HH:mm:ss')) AS tt, unix_timestamp(try_to_timestamp(event_type)) AS bad, from_unixtime(unix_timestamp(to_timestamp(date_format(ts, 'yyyy-MM-dd HH:mm:ss')))) AS fu, unix_timestamp(timestamp_seconds(event_id)) AS tsec FROM events",
    "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS tt, CAST(NULL AS BIGINT) AS bad, strftime(ts, '%Y-%m-%d %H:%M:%S') AS fu, event_id AS tsec FROM events",
)
R.pair(
    "fn_time_made",
    "SELECT n_nationkey, unix_timestamp(make_timestamp(2020, 1, 1 + n_nationkey, 3, 4, 5)) AS mt, CAST(DATE'2020-01-31' + make_interval(0, 1, 0, n_nationkey) AS DATE) AS mi FROM nation",
    "SELECT n_nationkey, CAST(epoch(make_timestamp(2020, 1, 1 + n_nationkey, 3, 4, 5)) AS BIGINT) AS mt, CAST(DATE '2020-01-31' + INTERVAL 1 MONTH + to_days(n_nationkey) AS DATE) AS mi FROM nation",
)
R.pair("fn_now", "SELECT n_nationkey, current_date() = curdate() AS d, now() = current_timestamp() AS t, current_user() = user() AS u, n_nationkey + datediff(current_date(), curdate()) AS k FROM nation", "SELECT n_nationkey, TRUE AS d, TRUE AS t, TRUE AS u, n_nationkey AS k FROM nation")
R.pair(
    "fn_array_aliases",
    "SELECT p_partkey, CAST(cardinality(split(p_name, ' ')) AS BIGINT) AS ca, CAST(array_size(split(p_name, ' ')) AS BIGINT) AS az, try_element_at(split(p_name, ' '), 9) AS te, array_join(array_compact(array(p_brand, CAST(NULL AS STRING), p_type)), '|') AS ac, reduce(array(p_size, 1, 2), 0, (a, x) -> a + x) AS re FROM part",
    "SELECT p_partkey, len(string_split(p_name, ' ')) AS ca, len(string_split(p_name, ' ')) AS az, string_split(p_name, ' ')[9] AS te, p_brand || '|' || p_type AS ac, p_size + 3 AS re FROM part",
)
R.pair("fn_map_made", "SELECT p_partkey, map_from_arrays(array('a', 'b'), array(p_size, 2))['a'] AS m, map_entries(map('k', p_size))[0].value AS v, map_entries(map('k', p_size))[0].key AS k FROM part", "SELECT p_partkey, p_size AS m, p_size AS v, 'k' AS k FROM part")
R.pair(
    "explode_outer_fn",
    "SELECT p_partkey, explode_outer(filter(array(p_size, p_size + 1), x -> x % 5 = 0)) AS v FROM part",
    "SELECT p_partkey, v FROM part LEFT JOIN LATERAL (SELECT unnest(list_filter([p_size, p_size + 1], lambda x: x % 5 = 0)) AS v) ON TRUE",
)
R.pair(
    "posexplode_outer_fn",
    "SELECT p_partkey, pos, v FROM (SELECT p_partkey, posexplode_outer(filter(array(p_size, p_size + 1, p_size + 2), x -> x % 5 < 2)) AS (pos, v) FROM part)",
    "SELECT p_partkey, CAST(pos AS INTEGER) AS pos, v FROM part LEFT JOIN LATERAL (SELECT generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS v FROM (SELECT list_filter([p_size, p_size + 1, p_size + 2], lambda x: x % 5 < 2) AS l)) ON TRUE",
)
R.pair(
    "inline_outer_fn",
    "SELECT p_partkey, a, b FROM (SELECT p_partkey, inline_outer(filter(array(struct(p_size AS a, p_brand AS b), struct(p_size + 1 AS a, p_type AS b)), x -> x.a % 5 = 0)) FROM part)",
    "SELECT p_partkey, a, b FROM part LEFT JOIN LATERAL (SELECT x.a AS a, x.b AS b FROM (SELECT unnest(list_filter([{'a': p_size, 'b': p_brand}, {'a': p_size + 1, 'b': p_type}], lambda x: x.a % 5 = 0)) AS x)) ON TRUE",
)
R.pair(
    "aggregate_aliases",
    "SELECT o_orderpriority, round(mean(o_totalprice), 4) AS m, some(o_totalprice > 400000) AS s, every(o_totalprice > 0) AS e, round(std(o_totalprice), 3) AS sd, array_join(sort_array(array_agg(DISTINCT o_orderstatus)), ',') AS st FROM orders GROUP BY o_orderpriority",
    "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS m, bool_or(o_totalprice > 400000) AS s, bool_and(o_totalprice > 0) AS e, round(stddev(o_totalprice), 3) AS sd, array_to_string(list_sort(array_agg(DISTINCT o_orderstatus)), ',') AS st FROM orders GROUP BY o_orderpriority",
)
R.add("fn_soundex", lambda spark, sf_dir: load(spark, sf_dir, "part").selectExpr("p_partkey", "soundex(p_name) AS s"))


def _filled(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A new table with declared columns, filled from ``nation``; its name is its own, since folders outlive a session's catalog."""
    load(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    name = f"{name}_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE TABLE {name} (k INT, name STRING, region INT) USING parquet")
    spark.sql(f"INSERT INTO {name} SELECT n_nationkey, n_name, n_regionkey FROM nation")
    return name


@R.frame("SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region FROM nation")
def ddl_create_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(_filled(spark, sf_dir, "querywright_made"))


@R.frame("SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region FROM nation WHERE n_regionkey = 1")
def ddl_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _filled(spark, sf_dir, "querywright_cut")
    spark.sql(f"TRUNCATE TABLE {name}")
    spark.sql(f"INSERT INTO {name} SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
    return spark.table(name)


@R.frame("SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY n_regionkey")
def ddl_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _filled(spark, sf_dir, "querywright_base")
    spark.sql(f"CREATE VIEW {name}_regions AS SELECT region, count(*) AS n FROM {name} GROUP BY region")
    return spark.table(f"{name}_regions")
