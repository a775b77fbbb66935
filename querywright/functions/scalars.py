"""Scalar function families over table columns."""

from ..tables import Registry

R = Registry()

R.same(
    fn_conditional="SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, ifnull(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg2, greatest(c_acctbal, 0.0) AS pos, least(c_acctbal, 0.0) AS neg FROM customer",
    fn_math="SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 9) AS sq, round(exp(l_discount), 9) AS ex, round(ln(l_extendedprice), 9) AS l, round(log10(l_extendedprice), 9) AS l10, round(log2(l_quantity), 9) AS l2, round(power(l_quantity, 2), 6) AS pw, CAST(sign(l_discount - 0.05) AS DOUBLE) AS sg, abs(l_discount - 0.05) AS ab FROM lineitem",
    fn_rounding="SELECT l_orderkey, l_linenumber, CAST(ceil(l_extendedprice) AS BIGINT) AS c, CAST(floor(l_extendedprice) AS BIGINT) AS f, round(l_quantity / 3, 1) AS r FROM lineitem",
    fn_string_case_pad="SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, repeat('x', p_size % 4) AS rep, reverse(p_name) AS rev, CAST(length(p_name) AS BIGINT) AS n FROM part",
    fn_string_search="SELECT p_partkey, substring(p_name, 2, 3) AS sub, left(p_name, 4) AS lf, right(p_name, 3) AS rt, replace(p_name, 'a', 'A') AS rep, translate(p_name, 'abc', 'xyz') AS tr, CAST(instr(p_name, 'a') AS BIGINT) AS pos, concat(p_brand, '-', p_name) AS cc, concat_ws('|', p_brand, p_type) AS cw FROM part",
    fn_trim="SELECT c_custkey, trim(concat('  ', c_name, ' ')) AS t, ltrim(concat('  ', c_name)) AS l, rtrim(concat(c_name, '  ')) AS r FROM customer",
    fn_starts_ends="SELECT p_partkey, contains(p_name, 'a') AS c, starts_with_a AS s FROM (SELECT p_partkey, p_name, p_name LIKE 'a%' AS starts_with_a FROM part) t",
    fn_hash_md5="SELECT c_custkey, md5(c_name) AS h FROM customer",
    fn_split_part="SELECT event_id, split_part(event_type, 'i', 1) AS a FROM events",
    fn_cast="SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS d, CAST(o_orderkey AS VARCHAR(20)) AS s, CAST(o_orderdate AS DATE) AS day FROM orders",
    fn_chr_ascii="SELECT n_nationkey, CAST(ascii(n_name) AS BIGINT) AS a, chr(65 + n_nationkey) AS c FROM nation",
    fn_date_parts="SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(hour(o_orderdate) AS BIGINT) AS h, CAST(dayofyear(o_orderdate) AS BIGINT) AS doy, CAST(weekofyear(o_orderdate) AS BIGINT) AS w, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS em FROM orders",
    fn_last_day="SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) AS eom FROM orders",
)
R.pair("fn_try_arith", "SELECT l_orderkey, l_linenumber, try_divide(l_extendedprice, l_discount) AS d, try_cast(l_returnflag AS INT) AS c FROM lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END AS d, TRY_CAST(l_returnflag AS INTEGER) AS c FROM lineitem")
R.pair("fn_nvl_if", "SELECT c_custkey, nvl(nullif(c_nationkey, 3), -1) AS n, nvl2(nullif(c_nationkey, 3), 'y', 'n') AS y, if(c_acctbal > 0, 'pos', 'neg') AS s, zeroifnull(nullif(c_nationkey, 3)) AS z, nullifzero(c_nationkey) AS nz FROM customer", "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS n, CASE WHEN nullif(c_nationkey, 3) IS NOT NULL THEN 'y' ELSE 'n' END AS y, CASE WHEN c_acctbal > 0 THEN 'pos' ELSE 'neg' END AS s, coalesce(nullif(c_nationkey, 3), 0) AS z, nullif(c_nationkey, 0) AS nz FROM customer")
R.pair("fn_math_more", "SELECT o_orderkey, pmod(-o_orderkey, 7) AS pm, mod(o_orderkey, 7) AS m, bround(o_totalprice, 0) AS br, width_bucket(o_totalprice, 0, 500000, 10) AS wb, round(pi() * e(), 9) AS pe FROM orders", "SELECT o_orderkey, ((-o_orderkey % 7) + 7) % 7 AS pm, o_orderkey % 7 AS m, round_even(o_totalprice, 0) AS br, CAST(CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 500000 THEN 11 ELSE floor(o_totalprice / 50000) + 1 END AS BIGINT) AS wb, round(pi() * exp(1), 9) AS pe FROM orders")
R.pair("fn_regex", "SELECT p_partkey, regexp_extract(p_name, '([a-z]+)', 1) AS first_word, regexp_replace(p_name, '[0-9]+', '#') AS masked, regexp_like(p_name, '[0-9]$') AS ends, CAST(regexp_count(p_name, '[a-z]') AS BIGINT) AS n, array_join(regexp_extract_all(p_name, '([a-z]+)', 1), ',') AS ws FROM part", "SELECT p_partkey, regexp_extract(p_name, '([a-z]+)', 1) AS first_word, regexp_replace(p_name, '[0-9]+', '#', 'g') AS masked, regexp_matches(p_name, '[0-9]$') AS ends, len(regexp_extract_all(p_name, '[a-z]')) AS n, array_to_string(regexp_extract_all(p_name, '([a-z]+)', 1), ',') AS ws FROM part")
R.pair("fn_split", "SELECT doc_id, CAST(size(split(text, ' ')) AS BIGINT) AS n, element_at(split(text, ' '), 1) AS head FROM documents", "SELECT doc_id, len(string_split(text, ' ')) AS n, string_split(text, ' ')[1] AS head FROM documents")
R.pair("fn_initcap_format", "SELECT c_custkey, initcap(lower(c_mktsegment)) AS seg, format_string('%05d|%.2f', c_custkey, c_acctbal) AS f, format_number(c_custkey * 1000, 0) AS g FROM customer", "SELECT c_custkey, upper(left(lower(c_mktsegment), 1)) || substring(lower(c_mktsegment), 2) AS seg, printf('%05d|%.2f', c_custkey, c_acctbal) AS f, format('{:,}', c_custkey * 1000) AS g FROM customer")
R.pair("fn_date_arith", "SELECT o_orderkey, date_add(CAST(o_orderdate AS DATE), 30) AS plus, date_sub(CAST(o_orderdate AS DATE), 7) AS minus, add_months(CAST(o_orderdate AS DATE), 2) AS months, datediff(DATE'2002-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS plus, CAST(CAST(o_orderdate AS DATE) - 7 AS DATE) AS minus, CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE) AS months, CAST(DATE '2002-01-01' - CAST(o_orderdate AS DATE) AS INTEGER) AS days FROM orders")
R.pair("fn_date_trunc", "SELECT o_orderkey, CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS m, trunc(CAST(o_orderdate AS DATE), 'YEAR') AS y, CAST(date_trunc('WEEK', o_orderdate) AS DATE) AS w FROM orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(date_trunc('year', o_orderdate) AS DATE) AS y, CAST(date_trunc('week', o_orderdate) AS DATE) AS w FROM orders")
R.pair("fn_date_format", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy/MM/dd HH:mm') AS f, to_date(date_format(o_orderdate, 'yyyyMMdd'), 'yyyyMMdd') AS d FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS f, CAST(o_orderdate AS DATE) AS d FROM orders")
R.pair("fn_unix_time", "SELECT event_id, unix_timestamp(CAST(ts AS TIMESTAMP)) AS s, unix_date(CAST(ts AS DATE)) AS d, date_from_unix_date(unix_date(CAST(ts AS DATE))) AS back FROM events", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INTEGER) AS d, CAST(ts AS DATE) AS back FROM events")
R.pair("fn_dayofweek", "SELECT o_orderkey, CAST(dayofweek(o_orderdate) AS BIGINT) AS dow, CAST(weekday(o_orderdate) AS BIGINT) AS wd, next_day(CAST(o_orderdate AS DATE), 'MON') AS nm FROM orders", "SELECT o_orderkey, CAST(dayofweek(o_orderdate) + 1 AS BIGINT) AS dow, CAST(isodow(o_orderdate) - 1 AS BIGINT) AS wd, CAST(CAST(o_orderdate AS DATE) + CAST(8 - isodow(o_orderdate) AS INTEGER) AS DATE) AS nm FROM orders")
R.pair("fn_make_date", "SELECT n_nationkey, make_date(2000 + n_nationkey, 2, 28) AS d, timestampadd(DAY, n_nationkey, TIMESTAMP_NTZ'2020-01-31 00:00:00') AS t, CAST(months_between(DATE'2021-03-31', DATE'2021-02-28') AS DOUBLE) AS mb FROM nation", "SELECT n_nationkey, make_date(2000 + n_nationkey, 2, 28) AS d, TIMESTAMP '2020-01-31 00:00:00' + to_days(n_nationkey) AS t, 1.0::DOUBLE AS mb FROM nation")
R.pair("fn_soundex_btrim", "SELECT n_nationkey, btrim(concat('xx', n_name, 'x'), 'x') AS b, substring_index(n_name, '_', -1) AS tail, typeof(n_name) AS ty FROM nation", "SELECT n_nationkey, trim(concat('xx', n_name, 'x'), 'x') AS b, split_part(n_name, '_', -1) AS tail, 'string' AS ty FROM nation")
