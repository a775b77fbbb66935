"""Plans: what reaches the scan, what joins become, projections and graded rewrites."""

import pytest
from pyspark.sql import functions as F

from querywright.plans import executed, projections, rewrites
from querywright.tables import load, sql


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    df = load(spark, sf_dir, "orders").filter("o_totalprice > 1000 AND o_orderstatus = 'F'").select("o_orderkey")
    scan = executed.scans(df)[0]
    assert "GreaterThan(o_totalprice" in scan["pushed"] and "EqualTo(o_orderstatus" in scan["pushed"]
    assert "o_orderdate" not in scan["columns"]


def test_topk_is_no_full_sort(spark, sf_dir):
    assert executed.operators(load(spark, sf_dir, "orders").orderBy("o_totalprice").limit(5))["TakeOrderedAndProject"] == 1


def test_exists_is_a_semi_join(spark, sf_dir):
    df = sql("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")(spark, sf_dir)
    assert "LeftSemi" in df._jdf.queryExecution().optimizedPlan().toString()


def test_explain_analyze(spark, sf_dir):
    text = [r["QUERY PLAN"] for r in executed.explain_analyze(load(spark, sf_dir, "nation").filter("n_regionkey = 1")).collect()]
    assert any("Scan" in x for x in text) and text[-1] == "Rows returned: 5"


def test_work_is_measured(spark, sf_dir):
    one = lambda: load(spark, sf_dir, "customer").groupBy("c_mktsegment").count()
    more = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").count()
    a, b = executed.work(one()), executed.work(more)
    assert a.rows == executed.work(one()).rows < b.rows and a.shuffled > 0 == a.spilled


@pytest.mark.parametrize("name", ["function_on_column", "running_total", "newest_per_group", "offset_page", "rank_by_count"])
def test_rewrites_agree(spark, sf_dir, name):
    slow, fast = (sql(x)(spark, sf_dir) for x in rewrites.PAIRS[name])
    assert rewrites.same_rows(slow, fast)


@pytest.mark.parametrize("name", sorted(rewrites.TARGETS))
def test_grading(spark, sf_dir, name):
    slow, fast = (sql(x)(spark, sf_dir) for x in rewrites.PAIRS[name])
    verdict = rewrites.grade(slow, fast, target=rewrites.TARGETS[name], ordered=name in rewrites.ORDERED)
    assert verdict.passed and verdict.same and verdict.fast.rows < verdict.slow.rows, verdict
    assert not rewrites.grade(slow, slow, target=0.99).passed
    assert not rewrites.same_rows(slow, fast.limit(3))


def test_same_rows(spark):
    a = spark.range(20).selectExpr("id % 7 AS x", "id AS y")
    assert rewrites.same_rows(a, a.orderBy(F.desc("y"))) and not rewrites.same_rows(a, a.unionAll(a)) and not rewrites.same_rows(a, a.select("x"))
    assert rewrites.same_rows(a.orderBy("x", "y"), a.orderBy("x", "y"), ordered=True)
    assert not rewrites.same_rows(a.orderBy("y"), a.orderBy(F.desc("y")), ordered=True)


def test_projections(spark, sf_dir, tmp_path):
    kept = projections.Registrar(str(tmp_path))
    orders = load(spark, sf_dir, "orders")
    kept.create(orders, "by_key", "orders", ["o_orderkey"], include=["o_custkey"], unique=True)
    with pytest.raises(ValueError, match="EXISTS"):
        kept.create(orders, "by_key", "orders", ["o_orderkey"])
    with pytest.raises(ValueError, match="UNIQUE"):
        kept.create(orders, "by_status", "orders", ["o_orderstatus"], unique=True)
    kept.create(orders, "late", "orders", ["o_orderdate"], include=["o_orderkey"], where="o_orderstatus = 'P'")
    assert kept.known["by_key"].covers(["o_custkey", "o_orderkey"]) and not kept.known["by_key"].covers(["o_totalprice"])
    assert not kept.known["late"].covers(["o_orderkey"]) and kept.known["late"].covers(["o_orderkey"], "o_orderstatus = 'P'")
    kept.drop("late")
    with pytest.raises(KeyError, match="NOT_FOUND"):
        kept.drop("late")


def test_skipping_report(spark, sf_dir):
    got = projections.skipping_report(
        load(spark, sf_dir, "orders"),
        {"range": F.col("o_orderkey") > 5, "wrapped": F.col("o_orderkey") % 7 == 3, "prefix": F.col("o_orderpriority").like("1%"), "suffix": F.col("o_orderpriority").like("%T")},
    )
    found = {r.predicate: r for r in got.collect()}
    assert found["range"].skips and found["prefix"].skips
    assert (found["range"].why, found["prefix"].why, found["wrapped"].why, found["suffix"].why) == (None, None, "NOT_PUSHED", "NO_RANGE")
