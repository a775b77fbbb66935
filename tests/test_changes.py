"""Row changes: casts, required columns, clause order, counts and the errors they raise."""

import pytest
from pyspark.sql import functions as F

from querywright.sources.changes import Clause, Merge, delete, insert, merge, update, write_version


@pytest.fixture()
def dim(spark):
    return spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "c", "y")], "id int, name string, tier string")


def test_insert_casts_and_fills(spark, dim):
    got = insert(dim, spark.createDataFrame([("7", "g")], "k string, n string"), ["id", "name"]).filter("id = 7").collect()
    assert [tuple(r) for r in got] == [(7, "g", None)]


def test_insert_checks(spark, dim):
    with pytest.raises(ValueError, match="ARITY"):
        insert(dim, dim.select("id"), ["id", "name"])
    with pytest.raises(Exception, match="NOT_NULL"):
        insert(dim, spark.createDataFrame([(None, "g")], "k int, n string"), ["id", "name"], required=["id"]).collect()
    assert insert(dim, dim.filter("id = 1"), overwrite=True).count() == 1


def test_update_is_simultaneous_and_null_keeps(dim):
    got = {r.id: (r.name, r.tier) for r in update(dim, {"name": F.col("tier"), "tier": F.col("name")}, F.col("tier") == "x").collect()}
    assert got == {1: ("x", "a"), 2: ("b", None), 3: ("c", "y")}


def test_delete_null_keeps(dim):
    assert sorted(r.id for r in delete(dim, F.col("tier") != "x").collect()) == [1, 2]
    assert delete(dim).count() == 0


def test_merge_first_clause_wins(spark, dim):
    src = spark.createDataFrame([(1, "A", "z"), (2, "B", "z"), (9, "N", "z"), (None, "Q", "z")], "id int, name string, tier string")
    plan = Merge(
        matched=[Clause("delete", F.col("s.name") == "B"), Clause("update", None, {"name": F.concat("t.name", "s.name")})],
        not_matched=[Clause("insert", F.col("s.id").isNotNull())],
        not_matched_by_source=[Clause("update", F.col("t.id") == 3, {"tier": F.lit("gone")})],
    )
    out, counts = merge(dim, src, F.col("t.id") == F.col("s.id"), plan)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "aA", "x"), (3, "c", "gone"), (9, "N", "z")]
    assert tuple(counts.first()) == (2, 1, 1)


def test_merge_twice_matched_raises(spark, dim):
    src = spark.createDataFrame([(1, "A", "z"), (1, "B", "z")], "id int, name string, tier string")
    with pytest.raises(ValueError, match="CARDINALITY"):
        merge(dim, src, F.col("t.id") == F.col("s.id"), Merge(matched=[Clause("update")]))


def test_versions_do_not_overwrite(spark, dim, tmp_path):
    first = write_version(dim, str(tmp_path))
    second = write_version(delete(first, F.col("id") == 1), str(tmp_path))
    assert (first.count(), second.count()) == (3, 2)
