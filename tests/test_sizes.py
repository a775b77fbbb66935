"""Queries on tables larger than the sample, and the shape of plans that decides how they grow."""

import re

from querywright.catalogue import queries


def test_hierarchy_is_not_cut_at_the_row_limit_of_recursion(spark, tmp_path):
    spark.range(1, 70_001).toDF("p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    got = queries()["recursive_hierarchy"](spark, str(tmp_path)).collect()  # 1.2 million rows of recursion; Spark's limit is a million
    assert sorted((r.k, r.depth) for r in got) == [(k, k.bit_length()) for k in range(1, 70_001)]


def test_lateral_top_rows_are_ranked_in_their_window(spark, sf_dir):
    plan = queries()["lateral_topn"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    window = re.search(r"Window \[row_number\(\).*", plan)[0]
    assert re.search(r"o_totalprice#\d+ DESC NULLS LAST, o_orderkey#\d+L ASC", window)  # a sort before the exchange is lost in it


def test_counted_ranks_keep_nulls_and_compare_no_pairs(spark, tmp_path):
    rows = [(k, None if k % 11 == 0 else k % 3, None if k % 7 == 0 else float(k % 5)) for k in range(1, 100)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    found = queries()["slow_rank_by_count"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" in plan
    groups = {}
    for k, nation, balance in rows:
        groups.setdefault(nation, []).append((balance is None, -(balance or 0.0), k))
    best = sorted(k for g in groups.values() for _, _, k in sorted(g)[:2])
    assert sorted(r.s_suppkey for r in found.collect()) == best


def test_richer_suppliers_are_counted_without_pairs(spark, tmp_path):
    rows = [(k, None if k % 11 == 0 else k % 3, None if k % 7 == 0 else float(k % 5)) for k in range(1, 100)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    found = queries()["scalar_correlated_noneq"](spark, str(tmp_path))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    richer = lambda a: sum(None not in (a[1], a[2], b[2]) and b[1] == a[1] and b[2] > a[2] for b in rows)
    assert sorted((r.s_suppkey, r.richer) for r in found.collect()) == [(r[0], richer(r)) for r in rows]
    assert found.schema["richer"].dataType.simpleString() == "bigint"


def test_sketches_are_held_for_statuses_only(spark, tmp_path):
    rows = [(k, k % 400, (None, "F", "O")[k % 3], float(k % 1000)) for k in range(6000)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    found = queries()["approx_functions"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    sketched = [line for line in plan.splitlines() if "Aggregate" in line and "approx_count_distinct" in line]
    assert sketched and not any("o_custkey" in re.search(r"keys?=\[.*?\]", line)[0] for line in sketched)
    assert sorted(map(tuple, found.collect()), key=repr) == [("F", True, True), ("O", True, True), (None, True, True)]


def test_sums_beyond_int_are_null_for_every_long_key(spark, tmp_path):
    keys = [-(2**40), -4294966649, -4294966648, -1, 0, 647, 648, 2**31, 2**40, None]
    row = "CAST(1 AS INT) AS l_linenumber, 4D AS l_quantity, 9D AS l_extendedprice, 0.1D AS l_discount, 0.5D AS l_tax"
    spark.createDataFrame([(k,) for k in keys], "l_orderkey long").selectExpr("l_orderkey", *row.split(", ")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_orderkey: r.over for r in queries()["fn_math_aliases"](spark, str(tmp_path)).collect()}
    assert got == {k: k + 2147483000 if k is not None and -(2**31) <= k + 2147483000 < 2**31 else None for k in keys}
    assert spark.sql("SELECT try_add(2147483647, 1)").first()[0] is None
