import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakestrata.operators import dims as D
from lakestrata.operators import evolve as E
from lakestrata.operators import load as L
from lakestrata.sources.write import write_layer
from tests.conftest import rows

SCHEMA = "k int, v string, ts int"


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_upsert_is_idempotent_and_dedups_its_source(spark):
    target = frame(spark, [(1, "a", 1), (2, "b", 1)])
    source = frame(spark, [(2, "old", 2), (2, "new", 3), (3, "c", 1)])
    once = L.upsert(target, source, ["k"], "ts")
    assert rows(once) == [(1, "a", 1), (2, "new", 3), (3, "c", 1)]
    assert rows(L.upsert(once, source, ["k"], "ts")) == rows(once)


def test_merge_updates_inserts_deletes(spark):
    target = frame(spark, [(1, "a", 1), (2, "b", 1), (3, "c", 1)])
    source = spark.createDataFrame(
        [(2, None, 9, False), (3, "x", 9, True), (4, "d", 9, False), (5, "e", 9, True), (6, "f", 9, None)],
        SCHEMA + ", gone boolean",
    )
    got = L.merge(target, source, ["k"], ["v"], "gone")
    assert rows(got) == sorted([(1, "a", 1), (2, None, 1), (4, "d", 9), (6, "f", 9)], key=repr)


def test_table_strategies(spark):
    spark.sql("CREATE TABLE t_load (v string, k int, dt string) USING parquet PARTITIONED BY (dt)")
    df = spark.createDataFrame([(1, "a", "d1"), (2, "b", "d2")], "k int, v string, dt string")
    L.append_table(df, "t_load")
    assert rows(spark.table("t_load")) == [("a", 1, "d1"), ("b", 2, "d2")]
    again = spark.createDataFrame([(7, "z", "d2")], "k int, v string, dt string")
    for _ in range(2):  # a rerun gives the same table
        L.overwrite_partitions(again, "t_load", "dt", ["d2"])
        assert rows(spark.table("t_load")) == [("a", 1, "d1"), ("z", 7, "d2")]
    L.overwrite_partitions(again.where("false"), "t_load", "dt", ["d2"])
    assert rows(spark.table("t_load")) == [("a", 1, "d1")]
    assert D.drop_expired(spark, "t_load", "2024-01-01", 1) == []
    spark.sql("DROP TABLE t_load")


def test_swap_tables(spark):
    frame(spark, [(1, "a", 1), (2, "b", 1)]).write.saveAsTable("t_swap")
    L.upsert_table(frame(spark, [(2, "c", 2)]), "t_swap", ["k"])
    assert rows(spark.table("t_swap")) == [(1, "a", 1), (2, "c", 2)]
    L.merge_table(frame(spark, [(3, "d", 1)]), "t_swap", ["k"])
    assert rows(spark.table("t_swap")) == [(1, "a", 1), (2, "c", 2), (3, "d", 1)]
    L.replace_table(frame(spark, [(9, "r", 0)]), "t_swap")
    assert rows(spark.table("t_swap")) == [(9, "r", 0)]
    spark.sql("DROP TABLE t_swap")


def test_upsert_partitions_leaves_other_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([(1, "a", 1, "x"), (2, "b", 1, "y")], SCHEMA + ", p string")
    write_layer(df, "DWD", path, ["p"])
    untouched = {f: f.stat().st_mtime_ns for f in (tmp_path / "p" / "p=x").glob("*.parquet")}
    L.upsert_partitions(spark.createDataFrame([(2, "c", 2, "y"), (3, "d", 1, "z")], df.schema), path, ["k", "p"], "p")
    assert rows(spark.read.schema(df.schema).parquet(path)) == [(1, "a", 1, "x"), (2, "c", 2, "y"), (3, "d", 1, "z")]
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "p" / "p=x").glob("*.parquet")} == untouched
    with pytest.raises(ValueError):
        L.upsert_partitions(df, path, ["k"], "p")


def test_null_keys_are_keys(spark):
    target = frame(spark, [(None, "old", 1), (1, "a", 1)])
    source = frame(spark, [(None, "new", 2)])
    once = L.upsert(target, source, ["k"])
    assert rows(once) == rows(L.upsert(once, source, ["k"])) == sorted([(1, "a", 1), (None, "new", 2)], key=repr)
    assert rows(L.merge(target, source, ["k"], ["v"])) == sorted([(1, "a", 1), (None, "new", 1)], key=repr)


def test_partitioned_tables_stay_what_they_are(spark):
    spark.sql("DROP TABLE IF EXISTS t_parts")
    spark.sql("CREATE TABLE t_parts (k int, v string, p int) USING orc PARTITIONED BY (p) COMMENT 'it''s kept' TBLPROPERTIES ('owner.name' = 'x')")
    L.append_table(spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3), (None, "n", 3)], "k int, v string, p int"), "t_parts")
    moved = spark.createDataFrame([(2, "moved", 4), (None, "m", 3), (5, "new", 1)], "k int, v string, p int")
    untouched = spark.table("t_parts").where("p = 1").inputFiles()
    for _ in range(2):
        L.upsert_table(moved, "t_parts", ["k"])
        assert rows(spark.table("t_parts")) == sorted([(1, "a", 1), (5, "new", 1), (3, "c", 3), (None, "m", 3), (2, "moved", 4)], key=repr)
    assert {r["partition"] for r in spark.sql("SHOW PARTITIONS t_parts").collect()} == {"p=1", "p=3", "p=4"}
    L.merge_table(spark.createDataFrame([(3, None, True), (None, None, True)], "k int, v string, gone boolean"), "t_parts", ["k"], delete_flag="gone")
    assert rows(spark.table("t_parts")) == sorted([(1, "a", 1), (5, "new", 1), (2, "moved", 4)], key=repr)
    assert {r["partition"] for r in spark.sql("SHOW PARTITIONS t_parts").collect()} == {"p=1", "p=4"}
    described = {r["col_name"]: r["data_type"] for r in spark.sql("DESCRIBE TABLE EXTENDED t_parts").collect()}
    assert described["Comment"] == "it's kept" and described["Provider"] == "orc"
    assert {r["key"]: r["value"] for r in spark.sql("SHOW TBLPROPERTIES t_parts").collect()}["owner.name"] == "x"
    with pytest.raises(ValueError):
        L.upsert_table(spark.createDataFrame([(9, "x", None)], "k int, v string, p int"), "t_parts", ["k"])
    assert untouched and spark.table("t_parts").count() == 3
    spark.sql("DROP TABLE t_parts")


def test_swapped_tables_keep_comment_and_properties(spark):
    spark.sql("DROP TABLE IF EXISTS t_kept")
    spark.sql("CREATE TABLE t_kept (k int, v string, ts int) USING orc COMMENT 'about' TBLPROPERTIES ('a.b' = 'it''s')")
    L.append_table(frame(spark, [(1, "a", 1), (None, "n", 1)]), "t_kept")
    for _ in range(2):
        L.upsert_table(frame(spark, [(None, "m", 2), (2, "b", 1)]), "t_kept", ["k"])
    assert rows(spark.table("t_kept")) == sorted([(1, "a", 1), (None, "m", 2), (2, "b", 1)], key=repr)
    described = {r["col_name"]: r["data_type"] for r in spark.sql("DESCRIBE TABLE EXTENDED t_kept").collect()}
    assert described["Comment"] == "about" and described["Provider"] == "orc"
    assert {r["key"]: r["value"] for r in spark.sql("SHOW TBLPROPERTIES t_kept").collect()}["a.b"] == "it's"
    spark.sql("DROP TABLE t_kept")


def test_newest_wins_in_any_batch_order(spark, tmp_path):
    batches = [[(1, "new", 5, "x")], [(1, "old", 3, "x"), (2, "b", 1, "x")]]
    results = []
    for name, order in (("f", batches), ("r", batches[::-1])):
        path = str(tmp_path / name)
        for batch in order:
            source = spark.createDataFrame(batch, SCHEMA + ", p string")
            L.upsert_partitions(source, path, ["k", "p"], "p", "ts", newest_wins=True)
        results.append(rows(spark.read.schema(SCHEMA + ", p string").parquet(path)))
    assert results[0] == results[1] == [(1, "new", 5, "x"), (2, "b", 1, "x")]


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def history(spark):
    data = [(1, "a", day(0)), (1, "a", day(40)), (1, "b", day(80)), (1, None, day(81)), (1, None, day(90)), (1, "b", day(200)), (2, "x", day(5))]
    return spark.createDataFrame(data, "k int, v string, ts timestamp_ntz")


def zipper(spark):
    return D.scd2_from_history(history(spark), ["k"], ["v"], "ts")


def test_scd2_versions(spark):
    got = sorted((tuple(r) for r in zipper(spark).collect()), key=lambda r: (r[0], r[2]))
    assert got == [
        (1, "a", day(0), day(80), False),
        (1, "b", day(80), day(81), False),
        (1, None, day(81), day(200), False),
        (1, "b", day(200), None, True),
        (2, "x", day(5), None, True),
    ]


def test_scd2_apply_is_idempotent_and_intervals_do_not_overlap(spark):
    changes = spark.createDataFrame([(1, "c"), (2, "x"), (3, "n")], "k int, v string")
    once = D.scd2_apply(zipper(spark), changes, ["k"], ["v"], F.lit("2024-12-01"))
    twice = D.scd2_apply(once, changes, ["k"], ["v"], F.lit("2024-12-31"))
    assert rows(once) == rows(twice)
    current = {r["k"]: r["v"] for r in once.where("is_current").collect()}
    assert current == {1: "c", 2: "x", 3: "n"}
    a, b = once.alias("a"), once.alias("b")
    clash = a.join(b, "k").where(
        "a.valid_from < b.valid_from AND coalesce(a.valid_to, timestamp_ntz'9999-01-01') > b.valid_from"
    )
    assert clash.isEmpty()


VERSIONS = "k int, v string, valid_from string, valid_to string, is_current boolean"


def apply_changes(spark, dimension, changes):
    dims = spark.createDataFrame(dimension, VERSIONS)
    return D.scd2_apply(dims, spark.createDataFrame(changes, "k int, v string, at string"), ["k"], ["v"], F.col("at"))


def test_scd2_apply_splits_and_settles_versions(spark):
    dimension = [(1, "a", "2024-01", "2024-05", False), (1, "b", "2024-05", None, True), (2, "x", "2024-01", "2024-03", False), (3, "z", "2024-02", None, True), (None, "n", "2024-01", None, True)]
    changes = [
        (1, "c", "2024-07"), (1, "d", "2024-06"), (1, "e", "2024-06"),  # several changes of a key, two of one time
        (2, "y", "2024-02"), (2, "w", "2024-08"),  # late, and after a gap
        (4, "new", "2024-02"), (4, "new", "2024-03"), (None, "m", "2024-04"), (3, "z", "2024-09"), (3, "q", None), (5, None, "2024-01"),
    ]
    found = apply_changes(spark, dimension, changes)
    assert rows(found) == sorted([
        (1, "a", "2024-01", "2024-05", False), (1, "b", "2024-05", "2024-06", False), (1, "e", "2024-06", "2024-07", False), (1, "c", "2024-07", None, True),
        (2, "x", "2024-01", "2024-02", False), (2, "y", "2024-02", "2024-03", False), (2, "w", "2024-08", None, True), (3, "z", "2024-02", None, True),
        (4, "new", "2024-02", None, True), (None, "n", "2024-01", "2024-04", False), (None, "m", "2024-04", None, True), (5, None, "2024-01", None, True),
    ], key=repr)
    again = [tuple(r) for r in found.collect()]
    assert rows(apply_changes(spark, again, changes)) == rows(found)


def test_scd2_apply_before_on_and_between_versions(spark):
    dimension = [(1, "a", "2024-03", "2024-05", False), (1, "b", "2024-05", None, True)]
    early = rows(apply_changes(spark, dimension, [(1, "o", "2024-01")]))
    assert early == [(1, "a", "2024-03", "2024-05", False), (1, "b", "2024-05", None, True), (1, "o", "2024-01", "2024-03", False)]
    assert rows(apply_changes(spark, dimension, [(1, "b", "2024-04")])) == [(1, "a", "2024-03", "2024-04", False), (1, "b", "2024-04", None, True)]
    assert rows(apply_changes(spark, dimension, [(1, "a", "2024-05")])) == [(1, "a", "2024-03", None, True)]
    assert rows(apply_changes(spark, dimension, [])) == rows(spark.createDataFrame(dimension, VERSIONS))
    assert rows(apply_changes(spark, [], [(1, "a", "2024-05")])) == [(1, "a", "2024-05", None, True)]


def test_scd2_apply_joins_without_moving_both_sides_whole(spark):
    dims = spark.createDataFrame([(1, "a", "2024-03", None, True)], VERSIONS)
    found = D.scd2_apply(dims, spark.createDataFrame([(1, "b", "2024-04")], "k int, v string, at string"), ["k"], ["v"], F.col("at"))
    assert "FullOuter" not in found._jdf.queryExecution().toString()


def test_scd3_keeps_the_previous_value(spark):
    dim = spark.createDataFrame([(1, "a", "z"), (2, "b", None)], "k int, v string, prev_v string")
    news = spark.createDataFrame([(1, "a"), (2, "c"), (3, "n")], "k int, v string")
    got = D.scd3(dim, news, ["k"], ["v"])
    assert rows(got) == sorted([(1, "a", "z"), (2, "c", "b"), (3, "n", None)], key=repr)


def test_drop_expired_partitions(spark):
    spark.sql("CREATE TABLE t_ret (k int, dt string) USING parquet PARTITIONED BY (dt)")
    data = [(1, "2024-01-01"), (2, "2024-03-30"), (3, "2024-03-31")]
    spark.createDataFrame(data, "k int, dt string").write.insertInto("t_ret")
    assert D.drop_expired(spark, "t_ret", "2024-04-01", 0) == []
    assert D.drop_expired(spark, "t_ret", "2024-04-01", 1) == ["2024-01-01", "2024-03-30"]
    assert rows(spark.table("t_ret")) == [(3, "2024-03-31")]
    spark.sql("DROP TABLE t_ret")


def test_schema_diff_and_its_inverse(spark):
    kind = "table_name string, column_name string, data_type string, comment string"
    a = spark.createDataFrame([("t", "id", "INT", ""), ("t", "x", "INT", "c"), ("t", "gone", "INT", "")], kind)
    b = spark.createDataFrame([("t", "id", "BIGINT", ""), ("t", "x", "INT", ""), ("t", "new", "INT", ""), ("t", "ID", "INT", "")], kind)
    changes = {(r["column_name"], r["change"]) for r in E.diff_schemas(a, b).collect()}
    assert changes == {("id", "type_changed"), ("gone", "removed"), ("new", "added"), ("ID", "added")}
    inverse = {(r["column_name"], r["change"]) for r in E.diff_schemas(b, a).collect()}
    assert inverse == {("id", "type_changed"), ("gone", "added"), ("new", "removed"), ("ID", "removed"), ("x", "comment_changed")}


def test_columns_frame_and_conform(spark):
    df = spark.createDataFrame([("7", "x")], "id string, s string")
    assert [r["data_type"] for r in E.columns_frame(df, "t").orderBy("position").collect()] == ["STRING", "STRING"]
    target = spark.createDataFrame([], "id bigint, added double, s int").schema
    assert E.conform(df, target).first().asDict() == {"id": 7, "added": None, "s": None}
