import pytest
from pyspark.sql import functions as F

from lakestrata.operators import audit as A
from lakestrata.operators import catalog as K
from lakestrata.operators import quality as Q
from lakestrata.operators import querylog as L
from lakestrata.operators import route as R
from tests.conftest import rows

DATA = [(1, 5.0), (2, None), (2, -1.0), (None, 3.0)]


def frame(spark):
    return spark.createDataFrame(DATA, "k int, amount double")


def test_report_counts_null_as_failure(spark):
    checks = [
        Q.Check("n", "null_check", ("k",), threshold=0.25),
        Q.Check("r", "range_check", ("amount",), low=0, high=10),
        Q.Check("u", "uniqueness", ("k",)),
        Q.Check("e", "expression", (), "amount > k"),
    ]
    got = {r["check_id"]: (r["total"], r["failed"], r["failed_rate"], r["passed"]) for r in Q.run_checks(frame(spark), checks).collect()}
    assert got == {"n": (4, 1, 0.25, True), "r": (4, 2, 0.5, False), "u": (4, 2, 0.5, False), "e": (4, 3, 0.75, False)}
    empty = Q.run_checks(frame(spark).where("false"), checks)
    assert [r["passed"] for r in empty.collect()] == [True] * 4


def test_actions(spark):
    df, seen = frame(spark), []
    fatal = Q.Check("f", "null_check", ("k",), action="fail")
    with pytest.raises(Q.DataQualityError, match="f"):
        Q.enforce(df, [fatal], seen.append)
    assert len(seen) == 1  # the report is out before the error
    passing, held = Q.enforce(df, [Q.Check("w", "null_check", ("k",), action="warn")])
    assert (passing.count(), held.count()) == (4, 0)
    skip = [Q.Check("s", "range_check", ("amount",), low=0, high=10, action="skip"), Q.Check("u", "uniqueness", ("k",), action="skip")]
    passing, held = Q.enforce(df, skip)
    assert rows(passing) == sorted([(1, 5.0), (None, 3.0)], key=repr) and held.count() == 2
    lenient = [Q.Check("s", "range_check", ("amount",), low=0, high=10, action="skip", threshold=0.5)]
    assert Q.enforce(df, lenient)[1].isEmpty()


def test_convention_checks_split_and():
    (check,) = Q.convention_checks(["tax_rate", "name"])
    assert check.expression == "`tax_rate` >= 0 AND `tax_rate` <= 1"
    assert [c.columns[0] for c in Q.not_null_checks(["user_id", "dt", "dts", "x_sk"])] == ["user_id", "dt", "x_sk"]


def test_expectations(spark):
    df = spark.range(3)
    assert Q.verify_table(df, 3, ["id"]) == []
    assert Q.verify_table(df, 4, ["ID"]) == ["expected 4 rows, found 3", "missing columns: ID"]
    assert Q.verify_query(spark, "SELECT 1 AS Total", ["TOTAL", "n"]) == ["n"]
    assert Q.produced_rows(df) and not Q.produced_rows(spark.range(0))


def test_reconcile_rounds_no_row(spark):
    nan = float("nan")
    detail = spark.createDataFrame([(0.00004, 0.1, 1e30, nan)] * 10, "a double, b double, c double, e double").selectExpr("*", "cast(0.000010 as decimal(10,6)) as f", "cast(1 as bigint) as g")
    summary = spark.createDataFrame([(0.0004, 1.0, 1e31, nan)], "a double, b double, c double, e double").selectExpr("*", "cast(0.000101 as decimal(10,6)) as f", "cast(10 as bigint) as g")
    got = {r["measure"]: r for r in Q.reconcile(detail, summary, {m: m for m in "abcefg"}).collect()}
    assert {m: r["balanced"] for m, r in got.items()} == {"a": True, "b": True, "c": True, "e": True, "f": False, "g": True}
    assert abs(got["a"]["detail_total"] - 0.0004) < 1e-12
    off = summary.withColumn("a", F.lit(0.0)).withColumn("e", F.lit(1.0))
    assert [r["balanced"] for r in Q.reconcile(detail, off, {"a": "a", "e": "e"}).collect()] == [False, False]
    assert str(Q.reconcile(detail, summary, {"f": "f"}).first()["detail_total"]) == "0.000100"


def test_reconcile(spark):
    detail = spark.createDataFrame([(1,), (2,)], "x int")
    got = Q.reconcile(detail, spark.createDataFrame([(3,)], "sx int"), {"x": "sx"}).first()
    assert got["balanced"] and float(got["detail_total"]) == 3
    assert not Q.reconcile(detail, spark.createDataFrame([(4,)], "sx int"), {"x": "sx"}).first()["balanced"]


COLUMNS = (
    "table_name string, table_comment string, column_name string, data_type string, nullable boolean, is_primary_key boolean, "
    "column_comment string, partition_keys array<string>, storage_format string, compression string"
)


def audited(spark, convention=None, **changes):
    base = dict(
        table_name="ods_sales", table_comment="[ODS] raw sales", column_name="amount", data_type="DECIMAL(18,2)", nullable=False,
        is_primary_key=True, column_comment="net amount", partition_keys=["dt"], storage_format="ORC", compression="SNAPPY",
    )
    df = spark.createDataFrame([tuple({**base, **changes}.values())], COLUMNS)
    found = sorted(r["rule"] for r in A.violations(df, convention).collect())
    return found, A.scores(df, convention).first()


def test_audit_of_a_clean_table(spark):
    found, score = audited(spark)
    assert found == [] and score["score"] == 100 and score["is_valid"]


@pytest.mark.parametrize(
    "changes, rules, score",
    [
        ({"data_type": "text"}, ["datatype.forbidden"], 85),
        ({"data_type": "MONEY"}, ["datatype.unknown_for_engine"], 95),
        ({"column_name": "user_key"}, ["naming.reserved_word_column"], 85),
        ({"column_name": "userKey", "nullable": True}, ["naming.column_case"], 95),
        ({"column_name": "row_key", "nullable": True}, ["naming.reserved_word_column", "quality.not_null"], 80),
        ({"column_name": "row_sk"}, ["quality.unique_hint"], 99),
        ({"column_comment": " "}, ["comment.column_required"], 95),
        ({"column_comment": "ab"}, ["comment.column_min_length"], 99),
        ({"table_comment": ""}, ["comment.table_required"], 85),
        ({"table_comment": "sales"}, ["comment.table_pattern"], 95),
        ({"partition_keys": ["day"]}, ["partition.column_mismatch"], 95),
        ({"partition_keys": []}, ["partition.missing"], 99),
        ({"is_primary_key": False}, ["quality.primary_key_required"], 95),
        ({"storage_format": "Parquet", "compression": "gzip"}, ["storage.compression", "storage.format"], 98),
        ({"table_name": "Sales"}, ["naming.table_case"], 85),
        ({"table_name": "ods_order_index"}, ["naming.reserved_word_table"], 85),
        ({"table_name": "ods_reorder"}, [], 100),
    ],
)
def test_audit_rules(spark, changes, rules, score):
    found, got = audited(spark, **changes)
    assert found == rules and got["score"] == score
    assert got["is_valid"] == (got["errors"] == 0)


def test_audit_options(spark):
    strict = A.Convention(strict_compat=True)
    assert audited(spark, strict)[0] == ["datatype.unknown_for_engine"]  # DECIMAL is only known with its parameters
    assert audited(spark, A.Convention(engine="unknown_engine"), data_type="MONEY")[0] == []
    assert A.template_regex("[{layer}] {description}") == r"\[.+\]\ .+"


def test_placement(spark):
    df = spark.createDataFrame([("ods_a", "ODS"), ("dwd_a", "ODS"), ("ODS_a", "ODS"), ("x", "NOPE"), ("dws_t_1d", "DWS")], "table_name string, layer string")
    got = {(r["table_name"], r["rule"]) for r in A.placement_problems(df).collect()}
    assert got == {
        ("dwd_a", "placement.prefix"), ("dwd_a", "placement.pattern"), ("dwd_a", "placement.foreign_prefix"),
        ("ODS_a", "placement.prefix"), ("ODS_a", "placement.pattern"), ("x", "placement.unknown_layer"),
    }


def test_statement_analysis(spark):
    log = spark.createDataFrame([(1, "select 1 from a"), (2, "DELETE FROM b"), (3, "SELECT 1; DROP TABLE x"), (4, " with c as (select 1) select * from c;")], "stmt_id int, sql string")
    got = {r["stmt_id"]: r for r in L.complexity(L.features(log)).collect()}
    assert (got[1]["subquery_count"], got[2]["subquery_count"]) == (0, -1)
    assert (got[1]["score"], got[1]["complexity"], got[1]["estimated_cost"]) == (0, "simple", 0)
    assert got[4]["operations"] == ["subquery", "cte"] and got[4]["score"] == 3 + 1 + 2
    assert got[4]["warnings"] == ["select_star"]
    safe = {r["stmt_id"]: (r["read_only"], r["multi_statement"], r["runs_as_query"]) for r in L.safety(log).collect()}
    assert safe == {1: (True, False, True), 2: (False, False, False), 3: (True, True, False), 4: (True, False, True)}


def entries(spark, data):
    kind = (
        "connection_id string, full_name string, table_name string, description string, layer string, category string, row_count bigint, "
        "tags array<string>, columns array<struct<name string, description string>>"
    )
    return spark.createDataFrame(data, kind)


def test_catalog_search_caps_and_filters(spark):
    cat = entries(
        spark,
        [
            ("c", "db.orders", "orders", "all orders", "dwd", "fact", 1, ["order"], [("order_id", "order key")] * 5),
            ("c", "db.users", "users", None, "dim", "dimension", 1, [], [("last_order", "")]),
            ("c", "db.none", "none", "", "ods", "other", 1, ["x"], []),
        ],
    )
    got = [(r["full_name"], r["score"]) for r in K.search(cat, "ORDER").collect()]
    assert got == [("db.orders", 1.0), ("db.users", 0.2)]
    assert [r["full_name"] for r in K.search(cat, "order", {"layer": "dim"}).collect()] == ["db.users"]
    assert K.search(cat, "order", limit=1).count() == 1
    with pytest.raises(ValueError):
        K.matching(cat, {"nope": "x"})
    assert [r["table_name"] for r in K.dictionary(cat, "c").collect()] == ["none", "orders", "users"]


def test_catalog_register_keeps_old_values_for_empty_ones(spark):
    old = entries(spark, [("c", "t", "t", "old", "dwd", "fact", 5, ["a"], [("x", "")])])
    new = entries(spark, [("c", "t", "t", "", None, "other", 0, [], []), ("c", "u", "u", "", "", "other", 0, [], [])])
    merged = {r["full_name"]: r for r in K.register(old, new).collect()}
    assert merged["t"] == old.first()
    assert merged["u"]["category"] == "other"


def test_catalog_register_leaves_other_fields_alone(spark):
    kind = "connection_id string, full_name string, description string, owner string, status string, size_bytes long"
    old = spark.createDataFrame([("c", "t", "old", "ann", "active", 5), (None, "n", "d", "bob", "x", 1)], kind)
    new = spark.createDataFrame([("c", "t", "new", "eve", "gone", 0), (None, "n", "e", None, None, 2), ("c", "u", None, "eve", "new", 0)], kind)
    found = K.register(old, new)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([("c", "t", "new", "ann", "active", 5), (None, "n", "e", "bob", "x", 2), ("c", "u", None, "eve", "new", 0)], key=repr)
    assert "FullOuter" not in found._jdf.queryExecution().toString()


def test_route_ties_and_misses(spark):
    df = spark.createDataFrame([("查询 重复",), ("DDL",), ("hello",), (None,)], "text string")
    got = [(r["label"], r["score"]) for r in R.route(df, "text").collect()]
    assert got[0] == ("sql_query", 2)  # 查询 and 查, against one hit for the other label
    assert got[1] == ("unknown", 0)  # keywords are compared as written with lower-cased text
    assert got[2] == ("unknown", 0)
    tie = R.route(df.where(F.col("text") == "hello"), "text", {"a": ["h"], "b": ["e"]}).first()
    assert (tie["label"], tie["score"]) == ("a", 1)
