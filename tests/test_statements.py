"""Guards and text expressions over statements that hide what they do."""

import pytest
from pyspark.sql import functions as F

from lakestrata.functions import statements as S
from lakestrata.operators import querylog as Q
from lakestrata.sources import write as W
from tests.conftest import rows

HIDDEN_WRITES = [
    "WITH x AS (SELECT '1' AS a) INSERT/**/INTO guarded SELECT a FROM x",
    r"WITH x AS (SELECT r'\' AS a) INSERT INTO guarded SELECT a FROM x WHERE a <> 'z'",
    "WITH x AS (SELECT 1 AS a) FROM x INSERT INTO guarded SELECT a",
    "WITH x AS (SELECT 1 AS a) /* ( /* */ ' */ INSERT OVERWRITE guarded SELECT a FROM x",
    "SELECT 1; DROP TABLE guarded",
    "WITH `SELECT` AS (SELECT 1 AS a) INSERT INTO guarded SELECT * FROM `SELECT`",
]
READS = [
    "SELECT ';' AS `INSERT INTO guarded`, \"it's -- here\" AS b -- ; DROP TABLE guarded",
    "WITH x(a) AS (SELECT abs((2))),y AS (SELECT * FROM x) SELECT a delete FROM y /* INSERT INTO /* t */ ( */",
    r"SELECT r'\' AS insert, 'it''s \' fine' AS b",
    "WITH x AS (SELECT 'insert into guarded' AS a) (SELECT * FROM x);",
]


def test_the_guard_asks_the_parser(spark):
    spark.sql("CREATE TABLE guarded (a STRING) USING parquet")
    more = ["SELECT TRANSFORM(a) USING 'cat' AS (b) FROM guarded", "SELECT reflect('java.lang.System', 'gc')", "SELECT 1 FROM range(3) WHERE id IN (SELECT java_method('a', 'b'))",
            "WITH x AS (SELECT 1", "SELECT 'open", "DESCRIBE guarded", "", "   ;"]
    for bad in HIDDEN_WRITES + more:
        with pytest.raises(ValueError):
            W.select(spark, bad)
    assert spark.table("guarded").count() == 0
    for good in READS:
        assert W.select(spark, good).count() == 1
    assert W.select(spark, "SELECT id FROM range(10) WHERE id IN (SELECT id FROM range(9)) AND id = :n", n=4).first()[0] == 4
    spark.sql("DROP TABLE guarded")


def test_safety_of_a_log(spark):
    log = spark.createDataFrame([*enumerate(HIDDEN_WRITES), *enumerate(READS, 100), (200, None), (201, ""), (202, "SELECT (1"), (203, "SELECT " + "(" * 60 + "1" + ")" * 60)], "stmt_id int, sql string")
    found = {r["stmt_id"]: r for r in Q.safety(log).collect()}
    assert not any(found[i]["runs_as_query"] for i in range(len(HIDDEN_WRITES))) and found[4]["multi_statement"]
    assert all(found[100 + i]["runs_as_query"] for i in range(len(READS)))
    assert [found[i]["runs_as_query"] for i in (200, 201, 202, 203)] == [False, False, False, True]


def test_long_statements_take_no_stack(spark):
    long = [f"SELECT '{'x' * 300_000}'", "SELECT " + "(a)," * 60_000 + "1", "SELECT 1 /*" + " * / '" * 60_000 + "*/", "SELECT " + "a'b\\'c'd" * 40_000]
    log = spark.createDataFrame(list(enumerate(long)), "stmt_id int, sql string")
    assert rows(Q.safety(log).select("stmt_id", "runs_as_query")) == [(i, True) for i in range(4)]


def test_parts_and_outline(spark):
    text = "a, f(b, (c)), 'x,y' AS d , `e,f`, g"
    got = spark.range(1).select(S.parts(S.bare(F.lit(text))).alias("p"), S.outline(S.bare(F.lit("x (a (b)) y ()"))).alias("o")).first()
    assert got["p"][:2] == ["a", "f(b, (c))"] and got["p"][-1] == "g" and got["o"] == "x () y ()"
