import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestrata.functions import numeric as N
from lakestrata.functions import text as X
from lakestrata.operators import aggregate as A
from lakestrata.operators import windows as W
from tests.conftest import rows


def test_keep_latest_breaks_ties_by_value_not_by_arrival(spark):
    data = [(1, 5, "b"), (1, 5, "a"), (1, 4, "z"), (2, None, "x"), (2, 1, "y")]
    for order in (data, data[::-1]):
        df = spark.createDataFrame(order, "k int, ts int, v string").repartition(4)
        assert rows(W.keep_latest(df, ["k"], "ts")) == [(1, 5, "a"), (2, 1, "y")]


def test_previous_and_next_row_equal_the_plain_window(spark):
    # One key holds most rows; values contain NULLs, buckets are skipped, a key may be NULL.
    df = spark.range(600).select(
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 20)).alias("k"),
        F.pmod(F.xxhash64("id"), F.lit(100)).alias("t"),
        "id",
        F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"),
    )
    w = Window.partitionBy("k").orderBy("t", "id")
    args = (["k"], ["t", "id"], {"near_v": "v", "near_id": "id"})
    for found, plain in ((W.previous_row(df, *args), F.lag), (W.next_row(df, *args), F.lead)):
        wanted = df.select("*", plain("v").over(w).alias("near_v"), plain("id").over(w).alias("near_id"))
        assert rows(found) == rows(wanted)


def test_neighbours_of_a_hot_day_are_spread(spark):
    # Two thirds of all rows are one key on one day.
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 50).alias("k"),
        F.when(F.col("id") % 3 > 0, F.lit("2024-01-05")).otherwise(F.concat(F.lit("2024-01-1"), F.col("id") % 10)).alias("day"),
        "id",
    )
    w = Window.partitionBy("k").orderBy("day", "id")
    found = W.neighbours(df, ["k"], ["day", "id"], {"b": "id"}, {"a": "id", "a_day": "day"})
    wanted = df.select("*", F.lag("id").over(w).alias("b"), F.lead("id").over(w).alias("a"), F.lead("day").over(w).alias("a_day"))
    assert rows(found) == rows(wanted)
    ranges = df.repartitionByRange(8, "k", "day", "id").groupBy(F.spark_partition_id()).count()
    assert ranges.agg(F.max("count")).first()[0] < 9000 / 8 * 2
    assert W.neighbours(df.limit(0), ["k"], ["id"], {"b": "id"}).collect() == []
    one = spark.createDataFrame([(None, 1), (None, 2)], "k int, id int")
    assert rows(W.neighbours(one, ["k"], ["id"], {"b": "id"}, {"a": "id"})) == [(None, 1, None, 2), (None, 2, 1, None)]


def test_dense_keys_are_unique_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), "id").repartition(13)
    keyed = W.dense_row_key(df, ["g", "id"])
    got = keyed.orderBy("row_key").collect()
    assert [r["row_key"] for r in got] == list(range(1, 1001))
    assert [(r["g"], r["id"]) for r in got] == sorted((r["g"], r["id"]) for r in got)
    unordered = W.dense_row_key(df)
    assert sorted(r[0] for r in unordered.select("row_key").collect()) == list(range(1, 1001))


def test_dense_keys_of_equal_rows(spark):
    same = spark.range(50).select(F.lit("x").alias("v"))
    assert sorted(r["row_key"] for r in W.dense_row_key(same).collect()) == list(range(1, 51))


def test_hashed_key_is_stable(spark):
    df = spark.range(20)
    assert rows(W.hashed_row_key(df.repartition(3), ["id"])) == rows(W.hashed_row_key(df, ["id"]))


def test_trailing_days_counts_calendar_days_not_rows(spark):
    days = [("a", dt.date(2024, 1, 1), 1), ("a", dt.date(2024, 1, 7), 2), ("a", dt.date(2024, 1, 8), 4)]
    df = spark.createDataFrame(days, "k string, d date, n int")
    got = {r["d"].day: r["n_7d"] for r in W.trailing_days(df, ["k"], "d", ["n"], 7).collect()}
    assert got == {1: 1, 7: 3, 8: 6}


def test_infer_rollup_follows_the_type_rule():
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("user_id", T.IntegerType()),
            T.StructField("amount", T.DecimalType(10, 2)),
            T.StructField("created_at", T.TimestampNTZType()),
            T.StructField("etl_time", T.TimestampNTZType()),
        ]
    )
    plan = A.infer_rollup(schema, ["id"])
    assert plan == A.InferredRollup(("created_at",), ("amount",), ("user_id",))
    numbers = T.StructType([T.StructField("n", T.LongType()), T.StructField("m", T.DoubleType())])
    assert A.infer_rollup(numbers).dimensions == ("n",)
    odd = T.StructType([T.StructField("point", T.StructType([T.StructField("a", T.IntegerType())])), T.StructField("span", T.DayTimeIntervalType()), T.StructField("s", T.ShortType()),
                        T.StructField("ints", T.ArrayType(T.IntegerType()))])
    assert A.infer_rollup(odd) == A.InferredRollup(("point", "span", "ints"), (), ("s",))


def test_rollup_rejects_mixed_grains():
    with pytest.raises(ValueError):
        A.rollup(None, [A.AggregationRule("a", "SUM", "x", ("k",)), A.AggregationRule("b", "SUM", "x", ("j",))])


@pytest.mark.parametrize("approximate", [False, True])
def test_profile_gives_doubles_exactly(spark, approximate):
    df = spark.createDataFrame([(1e-6, 0.1, -1e300), (2e-6, float("nan"), 1e300)], "a double, b double, c double")
    got = {r["column_name"]: (r["min_value"], r["max_value"]) for r in A.profile_columns(df, approximate=approximate).collect()}
    assert {k: tuple(map(float, v)) for k, v in got.items() if k != "b"} == {"a": (1e-6, 2e-6), "c": (-1e300, 1e300)}
    assert got["b"] == ("0.1", "NaN")


def test_profile_of_nulls_and_of_an_empty_table(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (None, None)], "n int, s string")
    got = {r["column_name"]: r for r in A.profile_columns(df).collect()}
    assert (got["n"]["row_count"], got["n"]["null_count"], got["n"]["distinct_count"]) == (3, 1, 1)
    assert got["s"]["null_ratio"] == pytest.approx(2 / 3)
    sketch = {r["column_name"]: r["distinct_count"] for r in A.profile_columns(df, approximate=True).collect()}
    assert sketch == {"n": 1, "s": 1}
    empty = A.profile_columns(df.where("false")).collect()
    assert {(r["row_count"], r["null_count"], r["null_ratio"]) for r in empty} == {(0, 0, 0.0)}


def test_row_overlap_is_a_multiset_and_knows_nulls(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "K int, v string")
    b = spark.createDataFrame([(None, 1, 0), (None, 1, 0), (None, 1, 0), ("y", 2, 0)], "v string, k int, extra int")
    assert A.row_overlap(a, b).first().asDict() == {"rows_a": 3, "rows_b": 4, "rows_shared": 2, "overlap": 2 / 3}


def test_table_statistics_of_an_empty_table(spark):
    assert A.table_statistics(spark.range(0), "t").first().asDict() == {
        "table_name": "t", "row_count": 0, "size_bytes": 0, "avg_row_bytes": None,
    }


def test_table_size_is_that_of_its_files(spark, tmp_path):
    spark.range(1000).repartition(3).write.parquet(str(tmp_path / "t"))
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    found = A.table_statistics(spark.read.parquet(str(tmp_path / "t")), "t").first()
    assert (found["row_count"], found["size_bytes"], found["avg_row_bytes"]) == (1000, size, size / 1000)


def test_names(spark):
    cases = {"OrderDetails": "order_details", "user-login-log": "user_login_log", "  Some Table  ": "some_table", "a__b": "a_b"}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r["n"]: r["s"] for r in df.select("n", X.snake_case(F.col("n")).alias("s")).collect()} == cases
    assert {k: X.snake_name(k) for k in cases} == cases


def test_domain_takes_the_first_keyword(spark):
    df = spark.createDataFrame([("user_orders",), ("login_item",), ("plain",), (None,)], "n string")
    got = [r[0] for r in df.select(X.domain_of(F.col("n"))).collect()]
    assert got == ["trade", "user", "common", "common"]


def test_globs(spark):
    df = spark.createDataFrame([("user_ID",), ("dt",), ("dts",), ("a.b",)], "n string")
    hit = X.matches_any_glob(F.col("n"), ("*_id", "dt", "a?b"))
    assert [r[0] for r in df.select(hit).collect()] == [True, True, False, True]


def test_cosine_of_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(N.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 0 and got[1] == pytest.approx(1)


def test_first_and_last_value_with_a_null_key(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("k", 1, "c")], "k string, t int, v string")
    got = W.attach_first_last(df, ["k"], ["t"], "v", "f", "l").select("k", "t", "f", "l")
    assert rows(got) == sorted([(None, 1, "a", "b"), (None, 2, "a", "b"), ("k", 1, "c", "c")], key=repr)
