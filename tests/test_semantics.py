"""ANSI values and error classes, and the DataFrame forms of constructs that SQL lacks here."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from querywright.operators import extras as X
from querywright.session import run_script, statements


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("7 / 2", "3.5"), ("7 DIV 2", "3"), ("-5 % 3", "-2"), ("pmod(-5, 3)", "1"), ("NULL AND FALSE", "false"), ("NULL OR TRUE", "true"),
        ("5 IN (1, NULL)", None), ("NULL <=> NULL", "true"), ("try_divide(1, 0)", None), ("try_cast('x' AS INT)", None),
        ("substring('hello', -3, 2)", "ll"), ("btrim('xxaxx', 'x')", "a"), ("split_part('a.b.c', '.', -1)", "c"),
        ("array(1, 2, 3)[0]", "1"), ("element_at(array(1, 2), -1)", "2"), ("map('a', 1)['b']", None), ("size(NULL)", None),
        ("date_add(DATE'2024-02-28', 2)", "2024-03-01"), ("add_months(DATE'2024-01-31', 1)", "2024-02-29"), ("last_day(DATE'2023-02-10')", "2023-02-28"),
        ("round(2.5D)", "3.0"), ("bround(2.5D)", "2.0"), ("map('k', 1, 'k', 2)['k']", "2"), ("aggregate(array(1, 2, 3), 0, (a, x) -> a + x)", "6"),
        ("'a' LIKE ANY ('b', 'a%')", "true"), ("get_json_object('{\"a\":[1,{\"b\":2}]}', '$.a[1].b')", "2"),
    ],
)
def test_values(spark, text, value):
    assert spark.sql(f"SELECT CAST({text} AS STRING)").first()[0] == value


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("SELECT 1 / 0", "DIVIDE_BY_ZERO"), ("SELECT CAST('abc' AS INT)", "CAST_INVALID_INPUT"), ("SELECT array(1)[5]", "INVALID_ARRAY_INDEX"),
        ("SELECT nope FROM range(1)", "UNRESOLVED_COLUMN"), ("SELECT nope(1)", "UNRESOLVED_ROUTINE"), ("SELECT * FROM nope", "TABLE_OR_VIEW_NOT_FOUND"),
        ("SELECT id, count(*) FROM range(3)", "MISSING_GROUP_BY|MISSING_AGGREGATION"), ("SELECT (SELECT id FROM range(3))", "SCALAR_SUBQUERY_TOO_MANY_ROWS"),
        ("SELECT 1 UNION SELECT 1, 2", "NUM_COLUMNS_MISMATCH"), ("SELECT id FROM range(1) a JOIN range(1) b", "AMBIGUOUS_REFERENCE"),
        ("SELEC 1", "PARSE_SYNTAX_ERROR"), ("SELECT sum(count(*)) FROM range(1)", "NESTED_AGGREGATE_FUNCTION"), ("SELECT to_timestamp('x')", "CANNOT_PARSE_TIMESTAMP|CAST_INVALID_INPUT"),
        ("SELECT CAST(300 AS TINYINT)", "CAST_OVERFLOW"), ("SELECT 9223372036854775807 + 1", "ARITHMETIC_OVERFLOW"), ("SELECT CAST('12.345' AS DECIMAL(2,1))", "NUMERIC_VALUE_OUT_OF_RANGE"),
        ("SELECT element_at(array(1), 5)", "INVALID_ARRAY_INDEX_IN_ELEMENT_AT"), ("SELECT element_at(array(1), 0)", "INVALID_INDEX_OF_ZERO"), ("SELECT split_part('a', '.', 0)", "INVALID_INDEX_OF_ZERO"),
        ("SELECT substring('a')", "WRONG_NUM_ARGS"), ("SELECT count(*) FROM range(3) GROUP BY 7", "GROUP_BY_POS_OUT_OF_RANGE"), ("SELECT id FROM range(3) ORDER BY 5", "ORDER_BY_POS_OUT_OF_RANGE"),
        ("SELECT count(*) FROM range(3) GROUP BY count(*)", "GROUP_BY_AGGREGATE"), ("SELECT * FROM range(1) a JOIN range(1) b USING (k)", "UNRESOLVED_USING_COLUMN_FOR_JOIN"),
        ("SELECT named_struct('a', 1).b", "FIELD_NOT_FOUND"), ("SELECT id FROM range(3) WHERE count(*) > 1", "INVALID_WHERE_CONDITION"), ("SELECT x.* FROM range(1)", "CANNOT_RESOLVE_STAR_EXPAND"),
        ("SELECT make_date(2020, 13, 1)", "DATETIME_FIELD_OUT_OF_BOUNDS"), ("SELECT * FROM VALUES (1), (1, 2)", "INVALID_INLINE_TABLE"), ("SELECT id.x FROM range(1)", "INVALID_EXTRACT_BASE_FIELD_TYPE"),
        ("SELECT abs(x -> x)", "INVALID_LAMBDA_FUNCTION_CALL"), ("SELECT id FROM range(3) LIMIT -1", "INVALID_LIMIT_LIKE_EXPRESSION"), ("SELECT (SELECT 1, 2)", "INVALID_SUBQUERY_EXPRESSION"),
        ("SELECT INTERVAL 'x' DAY", "INVALID_INTERVAL_FORMAT|must match|INTERVAL"), ("SELECT 1 + array(1)", "DATATYPE_MISMATCH"), ("SELECT CAST(1 AS nope)", "UNSUPPORTED_DATATYPE"), ("SELECT explode(array(1)) + 1", "UNSUPPORTED_GENERATOR"),
        ("SELECT from_json('{}', 'a b c')", "INVALID_SCHEMA|PARSE_SYNTAX_ERROR"), ("SELECT sum(id) OVER w FROM range(1)", "MISSING_WINDOW_SPECIFICATION"), ("SELECT row_number() OVER () FROM range(1)", "requires window to be ordered|WINDOW"),
        ("SELECT row_number() FROM range(1)", "WINDOW"), ("SELECT id FROM range(1) WHERE row_number() OVER (ORDER BY id) = 1", "UNSUPPORTED_EXPR_FOR_WINDOW|WHERE clause|window functions"), ("SELECT grouping(id) FROM range(1)", "GROUPING"),
        ("SELECT grouping(id + 1) FROM range(1) GROUP BY CUBE (id)", "GROUPING_COLUMN_MISMATCH"), ("SELECT upper(DISTINCT 'a')", "INVALID_SQL_SYNTAX|FUNCTION_WITH_UNSUPPORTED_SYNTAX|INVALID_DISTINCT|DISTINCT"),
        ("SELECT count(*) FROM range(1) a, range(1) b WHERE id = 1", "AMBIGUOUS_REFERENCE"), ("CREATE TABLE twice (a INT, a INT) USING parquet", "COLUMN_ALREADY_EXISTS"), ("DROP TABLE no_such_table", "TABLE_OR_VIEW_NOT_FOUND"),
        ("SELECT to_date('x', 'yyyy')", "CANNOT_PARSE_TIMESTAMP"), ("SELECT CAST('2024-13-01' AS DATE)", "CAST_INVALID_INPUT"), ("SELECT sequence(1, 5, -1)", "INVALID|ILLEGAL|illegal|boundaries"), ("SELECT regexp_extract('a', '(', 1)", "INVALID_PARAMETER_VALUE"),
    ],
)
def test_errors(spark, text, error):
    with pytest.raises(Exception, match=error):
        spark.sql(text).collect()


@pytest.fixture()
def t(spark):
    return spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", None, 1), ("b", 5, 2)], "k string, v int, ts int")


def test_qualify(t):
    w = Window.partitionBy("k").orderBy(F.desc("ts"))
    assert sorted((r.k, r.ts) for r in X.qualify(t, F.row_number().over(w) == 1).collect()) == [("a", 3), ("b", 2)]
    assert X.qualify(t, F.lag("v").over(Window.partitionBy("k").orderBy("ts")) > 1).count() == 1


def test_distinct_over(spark, t):
    got = {(r.k, r.ts): (r.n, r.s) for r in X.with_distinct(t.unionAll(spark.createDataFrame([(None, 7, 1), (None, 7, 2)], t.schema)), ["k"], "v", count="n", total="s").collect()}
    assert got == {("a", 1): (2, 3.0), ("a", 2): (2, 3.0), ("a", 3): (2, 3.0), ("b", 1): (1, 5.0), ("b", 2): (1, 5.0), (None, 1): (1, 7.0), (None, 2): (1, 7.0)}


def test_running_median(t):
    got = {(r.k, r.ts): r.m for r in X.running_median(t, ["k"], ["ts"], "v", "m").collect()}
    assert got == {("a", 1): 1.0, ("a", 2): 1.5, ("a", 3): 2.0, ("b", 1): None, ("b", 2): 5.0}


def test_places(spark):
    got = X.with_place(spark.range(1000).repartition(7).orderBy(F.desc("id"))).collect()
    assert all(r.place == 1000 - r.id for r in got) and len(got) == 1000


def test_soundex(spark, sf_dir):
    from querywright.catalogue import queries

    names = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    codes = {c: d for cs, d in (("BFPV", "1"), ("CGJKQSXZ", "2"), ("DT", "3"), ("L", "4"), ("MN", "5"), ("R", "6")) for c in cs}

    def plain(name):
        out, last = name[0].upper(), codes.get(name[0].upper())
        for c in name[1:].upper():
            d = codes.get(c)
            if d and d != last:
                out += d
            if c not in "HW":
                last = d
        return (out + "000")[:4]

    assert {r.p_partkey: r.s for r in queries()["fn_soundex"](spark, sf_dir).collect()} == {k: plain(v) for k, v in names.items()}


def test_recursion_stops_in_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "a int, b int")
    start = spark.createDataFrame([(1,)], "n int")
    reached = X.recursive_distinct(start, lambda new: new.join(edges, F.col("n") == F.col("a")).select("b"))
    assert sorted(r.n for r in reached.collect()) == [1, 2, 3]
    with pytest.raises(RecursionError):
        X.recursive_distinct(start, lambda new: new.select(F.col("n") + 1), most=3)


def test_scripts(spark):
    got = run_script(spark, "CREATE OR REPLACE TEMP VIEW v AS SELECT 1 AS x;\nSELECT x + 1 AS y FROM v;\n")
    assert got[1].first().y == 2
    got = run_script(spark, "SELECT 'a;\nb' AS x; -- a ; in a comment\n SELECT /* ; */ \"it''s;\" AS x, `c;d` FROM (SELECT 1 AS `c;d`);")
    assert [r.first().x for r in got] == ["a;\nb", "it''s;"]
    assert statements(" ; ;; ") == []


@pytest.mark.parametrize("text", ["SELECT 1; SELECT 2", "(SELECT 1)", "-- first\nSELECT 1", "WITH t AS (SELECT 1 AS x) SELECT * FROM t", "VALUES (1), (2)", "FROM range(3) SELECT id", "SHOW TABLES", "DESCRIBE QUERY SELECT 1 AS x", "EXPLAIN SELECT 1"])
def test_read_only_scripts_read(spark, text):
    assert all(r.collect() is not None for r in run_script(spark, text, read_only=True))


@pytest.mark.parametrize(
    "text",
    [
        "CREATE OR REPLACE TEMP VIEW w AS SELECT 1", "INSERT INTO dst SELECT 1", "WITH t AS (SELECT 1 AS x) INSERT INTO dst SELECT * FROM t", "FROM range(3) INSERT INTO dst SELECT id",
        "DELETE FROM dst", "UPDATE dst SET x = 1", "DROP TABLE dst", "TRUNCATE TABLE dst", "SET a.b = 1", "USE other", "CACHE TABLE dst", "CREATE TABLE z (x INT)", "SELECT 1; INSERT INTO dst SELECT 1",
        "MERGE INTO dst USING src ON dst.x = src.x WHEN MATCHED THEN DELETE",
    ],
)
def test_read_only_scripts_do_not_write(spark, text):
    spark.sql("DROP TABLE IF EXISTS dst")
    spark.sql("CREATE TABLE dst (x BIGINT) USING parquet")
    with pytest.raises(PermissionError):
        run_script(spark, text, read_only=True)
    assert spark.table("dst").count() == 0
    spark.sql("DROP TABLE dst")


def test_tables_and_views_of_a_script(spark):
    got = run_script(
        spark,
        """DROP TABLE IF EXISTS made; CREATE TABLE made (k INT, v STRING) USING parquet; INSERT INTO made VALUES (1, 'a'), (2, 'b');
        CREATE OR REPLACE TEMP VIEW seen AS SELECT v FROM made WHERE k = 2; SHOW TABLES LIKE 'made'; DESCRIBE TABLE made; TRUNCATE TABLE made; SELECT count(*) AS n FROM made;
        DROP VIEW seen; DROP TABLE made""",
    )
    assert [r.tableName for r in got[4].collect()] == ["made"]
    assert [(r.col_name, r.data_type) for r in got[5].collect()] == [("k", "int"), ("v", "string")]
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        spark.sql("SELECT * FROM seen").collect()
