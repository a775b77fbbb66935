"""Arrays, maps, structs, JSON, higher-order functions and generators."""

from ..tables import Registry

R = Registry()

R.pair("arr_basic", "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, CAST(element_at(embedding, 1) AS DOUBLE) AS a, CAST(element_at(embedding, -1) AS DOUBLE) AS z, CAST(array_max(embedding) AS DOUBLE) AS hi, CAST(array_min(embedding) AS DOUBLE) AS lo, CAST(embedding[1] AS DOUBLE) AS second FROM embeddings", "SELECT vec_id, len(embedding) AS n, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[-1] AS DOUBLE) AS z, CAST(list_max(embedding) AS DOUBLE) AS hi, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(embedding[2] AS DOUBLE) AS second FROM embeddings")
R.pair("arr_setops", "SELECT n_nationkey, array_join(sort_array(array_union(array(n_nationkey, 1, 2), array(2, 3))), ',') AS u, array_join(sort_array(array_intersect(array(n_nationkey, 1, 2), array(2, 3))), ',') AS i, array_join(sort_array(array_except(array(n_nationkey, 1, 2), array(2, 3))), ',') AS e, arrays_overlap(array(n_nationkey), array(2, 3)) AS o, array_contains(array(1, 2), n_nationkey) AS c FROM nation", "SELECT n_nationkey, array_to_string(list_sort(list_distinct([n_nationkey, 1, 2, 2, 3])), ',') AS u, array_to_string(list_sort(list_intersect(list_distinct([n_nationkey, 1, 2]), [2, 3])), ',') AS i, array_to_string(list_sort(list_distinct(list_filter([n_nationkey, 1, 2], lambda x: NOT list_contains([2, 3], x)))), ',') AS e, n_nationkey IN (2, 3) AS o, n_nationkey IN (1, 2) AS c FROM nation")
R.pair("arr_edit", "SELECT n_nationkey, array_join(array_append(array_prepend(array(n_nationkey), 0), 9), ',') AS a, array_join(array_remove(array(1, n_nationkey, 1), 1), ',') AS r, array_join(slice(sequence(1, 10), 3, 4), ',') AS s, array_join(flatten(array(array(1), array(n_nationkey))), ',') AS f, array_join(array_repeat(n_nationkey, 2), ',') AS d, CAST(array_position(array(5, n_nationkey), n_nationkey) AS BIGINT) AS p, array_join(array_distinct(array(1, 1, n_nationkey)), ',') AS u FROM nation", "SELECT n_nationkey, array_to_string([0, n_nationkey, 9], ',') AS a, array_to_string(list_filter([1, n_nationkey, 1], lambda x: x <> 1), ',') AS r, '3,4,5,6' AS s, array_to_string([1, n_nationkey], ',') AS f, array_to_string([n_nationkey, n_nationkey], ',') AS d, CAST(list_position([5, n_nationkey], n_nationkey) AS BIGINT) AS p, CASE WHEN n_nationkey = 1 THEN '1' ELSE concat('1,', n_nationkey) END AS u FROM nation")
R.pair("arr_hof_transform_filter", "SELECT n_regionkey, array_join(transform(filter(ks, k -> k % 2 = 0), (k, i) -> k * 10 + i), ',') AS t, exists(ks, k -> k > 20) AS ex, forall(ks, k -> k >= 0) AS fa FROM (SELECT n_regionkey, sort_array(collect_list(n_nationkey)) AS ks FROM nation GROUP BY n_regionkey) g", "SELECT n_regionkey, array_to_string(list_transform(list_filter(ks, lambda k: k % 2 = 0), lambda k, i: k * 10 + i - 1), ',') AS t, len(list_filter(ks, lambda k: k > 20)) > 0 AS ex, len(list_filter(ks, lambda k: k < 0)) = 0 AS fa FROM (SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS ks FROM nation GROUP BY n_regionkey) g")
R.pair("arr_aggregate", "SELECT vec_id, round(aggregate(zip_with(embedding, embedding, (a, b) -> CAST(a AS DOUBLE) * b), CAST(0 AS DOUBLE), (s, x) -> s + x), 5) AS dot FROM embeddings", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda a: CAST(a AS DOUBLE) * a)), 5) AS dot FROM embeddings")
R.pair("arr_sort_cmp", "SELECT n_regionkey, array_join(array_sort(collect_list(n_nationkey), (a, b) -> CASE WHEN a > b THEN -1 WHEN a < b THEN 1 ELSE 0 END), ',') AS down FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_nationkey, ',' ORDER BY n_nationkey DESC) AS down FROM nation GROUP BY n_regionkey")
R.pair("map_basic", "SELECT n_regionkey, array_join(sort_array(map_keys(m)), ',') AS ks, array_join(sort_array(map_values(m)), ',') AS vs, map_contains_key(m, n_regionkey) AS has, CAST(size(map_filter(m, (k, v) -> k > 10)) AS BIGINT) AS big, element_at(m, n_regionkey) AS own FROM (SELECT n_regionkey, map_from_entries(collect_list(struct(n_nationkey, n_name))) AS m FROM nation GROUP BY n_regionkey) t", "SELECT n_regionkey, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS ks, string_agg(n_name, ',' ORDER BY n_name) AS vs, bool_or(n_nationkey = n_regionkey) AS has, count(*) FILTER (WHERE n_nationkey > 10) AS big, max(CASE WHEN n_nationkey = n_regionkey THEN n_name END) AS own FROM nation GROUP BY n_regionkey")
R.pair("struct_field", "SELECT s.k AS k, s.name AS name FROM (SELECT named_struct('k', n_nationkey, 'name', n_name) AS s FROM nation) t", "SELECT s.k AS k, s.name AS name FROM (SELECT {'k': n_nationkey, 'name': n_name} AS s FROM nation) t")
R.pair("arr_struct_field", "SELECT r, array_join(sort_array(ns.n_name), ',') AS names FROM (SELECT n_regionkey AS r, collect_list(struct(n_nationkey, n_name)) AS ns FROM nation GROUP BY n_regionkey) t", "SELECT n_regionkey AS r, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
R.pair("json_path", "SELECT event_id, get_json_object(props, '$.k') AS k, CAST(size(json_object_keys(props)) AS BIGINT) AS n FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props)) AS n FROM events")
R.pair("from_to_json", "SELECT event_id, from_json(props, 'k INT').k AS k, to_json(named_struct('id', event_id)) AS j FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, concat('{\"id\":', event_id, '}') AS j FROM events")
R.pair("explode", "SELECT vec_id, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, explode(embedding) AS x FROM embeddings) t", "SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings")
R.pair("posexplode", "SELECT vec_id, pos, CAST(x AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, x", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) t")
R.pair("explode_outer", "SELECT n_nationkey, x FROM nation LATERAL VIEW OUTER explode(filter(array(n_nationkey), k -> k > 12)) e AS x", "SELECT n_nationkey, CASE WHEN n_nationkey > 12 THEN n_nationkey END AS x FROM nation")
R.pair("inline_structs", "SELECT r, k, name FROM (SELECT n_regionkey AS r, collect_list(struct(n_nationkey, n_name)) AS ns FROM nation GROUP BY n_regionkey) t LATERAL VIEW inline(ns) e AS k, name", "SELECT n_regionkey AS r, n_nationkey AS k, n_name AS name FROM nation")
R.pair("word_counts", "SELECT w, count(*) AS n FROM (SELECT explode(split(lower(text), '[^a-z]+')) AS w FROM benchmark) t WHERE w <> '' GROUP BY w", "SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM benchmark) t WHERE w <> '' GROUP BY w")
R.pair("page_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(size(regexp_extract_all(html, '<a ', 0)) AS BIGINT) AS links FROM pages", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a ')) AS links FROM pages")
R.pair("str_to_map_zip", "SELECT n_nationkey, str_to_map(concat('a=', n_nationkey, ';b=2'), ';', '=')['a'] AS a, arrays_zip(array(n_nationkey), array(n_name))[0]['1'] AS z FROM nation", "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS a, n_name AS z FROM nation")
R.pair("transform_values_fn", "SELECT n_nationkey, transform_values(map('a', n_nationkey), (k, v) -> v + 1)['a'] AS v, CAST(json_array_length(concat('[', n_nationkey, ',1]')) AS BIGINT) AS jl FROM nation", "SELECT n_nationkey, n_nationkey + 1 AS v, CAST(2 AS BIGINT) AS jl FROM nation")
