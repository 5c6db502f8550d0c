"""Faults that clean inputs do not show: types of partitions, NULL keys, empty reruns, writes behind WITH."""

import pytest
from pyspark.sql import functions as F

from lakestrata.operators import catalog as C
from lakestrata.operators import lineage as N
from lakestrata.operators import load as L
from lakestrata.operators import querylog as Q
from lakestrata.plans import layered as P
from lakestrata.plans.run_log import run_step
from lakestrata.sources import extract as X
from lakestrata.sources import write as W
from tests.conftest import rows


def test_overwrite_of_int_partitions_keeps_what_it_wrote(spark):
    spark.sql("DROP TABLE IF EXISTS int_parts")
    spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "k int, p int").write.partitionBy("p").saveAsTable("int_parts")
    L.overwrite_partitions(spark.createDataFrame([(10, 1)], "k int, p int"), "int_parts", "p", [1, "02"])
    assert rows(spark.table("int_parts")) == [(10, 1), (3, 3)]
    with pytest.raises(ValueError):
        L.overwrite_partitions(spark.createDataFrame([(10, 1)], "k int, p int"), "int_parts", "p", ["x"])
    spark.sql("DROP TABLE int_parts")


def test_upsert_refuses_a_null_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, None), (2, "a")], "k int, dt string").write.partitionBy("dt").parquet(path)
    with pytest.raises(ValueError):
        L.upsert_partitions(spark.createDataFrame([(3, None)], "k int, dt string"), path, ["k", "dt"], "dt")
    assert spark.read.parquet(path).count() == 2


def test_rerun_with_an_empty_day_removes_the_day(spark, tmp_path):
    plan = P.LayerPlan(keys=("k",), order_column="v", dimensions=("g",), metrics=(F.count("*").alias("n"),), report=("g", "n"), types={}, defaults={})
    source = spark.createDataFrame([(1, 1, "x")], "k int, v int, g string")
    paths = P.run_day(source, plan, "2024-01-02 00:00:00", "2024-01-01", str(tmp_path))
    P.run_day(source, plan, "2024-01-03 00:00:00", "2024-01-02", str(tmp_path))
    P.run_day(source.where("k > 5"), plan, "2024-01-02 00:00:00", "2024-01-01", str(tmp_path))
    for layer, path in paths.items():
        stored = spark.read.format(W.LAYER_STORAGE[layer].file_format).load(path)
        assert [str(r["dt"]) for r in stored.select("dt").distinct().collect()] == ["2024-01-02"], layer


def test_incremental_rows_end_at_the_mark(spark, tmp_path):
    path = str(tmp_path / "grow")
    spark.createDataFrame([(1, 1), (2, None)], "k int, ts int").write.parquet(path)
    fresh, mark = X.extract_incremental(spark.read.schema("k int, ts int").parquet(path), "ts", None)
    assert rows(mark) == [(1,)] and rows(fresh) == [(1, 1), (2, None)]
    fresh, mark = X.extract_incremental(spark.createDataFrame([(3, 9)], "k int, ts int"), "ts", 9)
    assert rows(fresh) == [] and rows(mark) == [(9,)]


def test_cdc_reads_operations_in_any_case(spark):
    log = spark.createDataFrame([(1, 1, "I"), (1, 2, "DELETE"), (2, 1, None), (3, 1, "d")], "k int, seq int, op string")
    assert rows(X.extract_cdc(log, ["k"], "seq", "op")) == [(2,)]


def test_read_only_guard_looks_behind_with(spark):
    for bad in ("WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "with x as (select 1) merge into t using x on 1=1", "SELECT 1; SELECT 2", "DROP TABLE t"):
        with pytest.raises(ValueError):
            W.check_read_only(spark, bad)
    for good in ("SELECT ';' AS a;", "WITH x AS (SELECT 'insert into t' AS a) SELECT * FROM x -- delete from t;"):
        assert rows(W.select(spark, good))
    log = spark.createDataFrame([(1, "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x"), (2, "SELECT ';' AS a")], "stmt_id int, sql string")
    found = {r["stmt_id"]: (r["read_only"], r["multi_statement"]) for r in Q.safety(log).collect()}
    assert found == {1: (False, False), 2: (True, False)}


def test_traces_and_cycles_have_no_hidden_limit(spark):
    chain = spark.createDataFrame([(f"t{i:02}", f"t{i + 1:02}") for i in range(24)], "src string, dst string")
    assert N.trace(chain, "t00").count() == 24
    ring = spark.createDataFrame([(str(i), str((i + 1) % 6)) for i in range(6)], "src string, dst string")
    assert rows(N.cycles(ring).select("length")) == [(6,)]


def test_step_without_rows_is_a_good_run(spark):
    source = spark.range(3)
    record = run_step("none", source, lambda df: df.where(F.lit(False)), lambda df: df.write.format("noop").mode("overwrite").save()).first()
    assert (record["status"], record["rows_written"]) == ("success", 0)
    failed = run_step("bad", source, lambda df: df, lambda df: (_ for _ in ()).throw(ValueError("one\ntwo"))).first()
    assert failed["error"] == "one\ntwo"


def test_search_finds_entries_without_tags(spark):
    kind = "table_name string, full_name string, connection_id string, description string, columns array<struct<name:string,description:string>>, tags array<string>"
    entry = spark.createDataFrame([("orders", "db.orders", "c", None, None, None)], kind)
    assert C.search(entry, "orders").count() == 1
