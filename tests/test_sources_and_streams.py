import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestrata import session
from lakestrata.operators.aggregate import analyzed_statistics
from lakestrata.operators import transform as R
from lakestrata.plans import layered as P
from lakestrata.plans.run_log import run_step
from lakestrata.sources import extract as X
from lakestrata.sources import generate as G
from lakestrata.sources import write as W
from lakestrata.streaming import jobs as S
from tests.conftest import rows


def test_jdbc_options():
    o = X.jdbc_options("mysql", "h", 3306, "shop", table="orders", split=("id", 1, 100, 8))
    assert o["url"] == "jdbc:mysql://h:3306/shop" and o["dbtable"] == "orders" and o["fetchsize"] == "100000"
    assert (o["partitionColumn"], o["lowerBound"], o["upperBound"], o["numPartitions"]) == ("id", "1", "100", "8")
    q = X.jdbc_options("postgresql", "h", 5432, "d", query="SELECT 1")
    assert q["query"] == "SELECT 1" and "dbtable" not in q
    assert X.jdbc_options("oracle", "h", 1, "d", query="SELECT 1", split=("a", 0, 9, 2))["dbtable"] == "(SELECT 1) q"
    for bad in ({"kind": "mysql"}, {"kind": "mysql", "table": "a", "query": "b"}, {"kind": "nope", "table": "a"}):
        with pytest.raises(ValueError):
            X.jdbc_options(host="h", port=1, database="d", **bad)


def test_csv_columns_are_matched_by_name(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("absent", T.DateType())])
    (tmp_path / "a.csv").write_text('Name,extra,id\n"x, y",zz,7\n,q,8\n')
    assert rows(X.read_csv(spark, str(tmp_path), schema)) == sorted([(7, "x, y", None), (8, None, None)], key=repr)
    (tmp_path / "b.csv").write_text("id,Name,extra\n1,a,b\n")
    with pytest.raises(Exception, match="(?i)header"):
        X.read_csv(spark, str(tmp_path), schema).collect()


def test_watermark_stays_when_nothing_is_new(spark):
    df = spark.createDataFrame([(1, 10), (2, 20)], "id int, ts int")
    fresh, mark = X.extract_incremental(df, "ts", None)
    assert fresh.count() == 2 and mark.first()[0] == 20
    fresh, mark = X.extract_incremental(df, "ts", 20)
    assert fresh.isEmpty() and mark.first()[0] == 20


def test_csv_gives_the_same_rows_back(spark, tmp_path):
    texts = ["two\nlines", "cr\r\nlf", "lone\rcr", " blanks ", "", None, 'say "hi"', "a,b", "back\\slash", '\\"', "#no comment", '"', "\t", "N", "ä\u2028ö", "''", "NaN"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    W.export_csv(df, str(tmp_path / "out"))
    assert rows(X.read_csv(spark, str(tmp_path / "out"), df.schema)) == rows(df)
    good, held = X.read_csv_checked(spark, str(tmp_path / "out"), df.schema)
    assert rows(good) == rows(df) and held.collect() == []


def test_bad_csv_rows_are_held_back(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,a\nx,b\n2,"c\nd"\n3,e,too many\n4\n')
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    good, held = X.read_csv_checked(spark, str(tmp_path), schema)
    assert rows(good) == [(1, "a"), (2, "c\nd")]
    assert sorted(r["record"].strip() for r in held.collect()) == ["3,e,too many", "4", "x,b"] and held.first()["file"].endswith("a.csv")


def test_sample_bounds(spark):
    assert [X.sample_head(spark.range(50), n).count() for n in (-1, 5, 99)] == [1, 5, 20]
    assert X.preview(spark.range(500)).count() == 100


def test_read_only_guard(spark):
    assert W.select(spark, "SELECT :n AS n;", n=3).first()[0] == 3
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO t SELECT 1"):
        with pytest.raises(ValueError):
            W.select(spark, bad)
    with pytest.raises(ValueError):
        W.create_view(spark, "bad-name", "SELECT 1")


def test_create_table_as_replaces_and_comments(spark):
    for n in (2, 3):
        count, columns = W.create_table_as(spark, "t_ctas", f"SELECT id AS k FROM range({n})", "it's a table")
        assert (count, columns) == (n, ["k"])
    comment = spark.sql("DESCRIBE TABLE EXTENDED t_ctas").where("col_name = 'Comment'").first()["data_type"]
    assert comment == "it's a table"
    rows_, size = analyzed_statistics(spark, "t_ctas")
    assert rows_ == 3 and size > 0
    assert X.read_table(spark, "t_ctas").count() == 3
    assert X.extract_query(spark, "SELECT count(*) AS n FROM t_ctas").first()[0] == 3
    spark.sql("DROP TABLE t_ctas")


SCHEMA = T.StructType(
    [
        T.StructField("id", T.IntegerType()), T.StructField("big", T.LongType()), T.StructField("small", T.ShortType()),
        T.StructField("tiny", T.ByteType()), T.StructField("n", T.IntegerType()), T.StructField("ok", T.BooleanType()),
        T.StructField("f", T.FloatType()), T.StructField("d", T.DoubleType()), T.StructField("money", T.DecimalType(10, 2)),
        T.StructField("wide", T.DecimalType(38, 0)), T.StructField("day", T.DateType()), T.StructField("at", T.TimestampNTZType()),
        T.StructField("raw", T.BinaryType()), T.StructField("email", T.StringType()), T.StructField("status", T.StringType()),
        T.StructField("type_code", T.StringType()), T.StructField("link", T.StringType()), T.StructField("customer_name", T.StringType()),
        T.StructField("js", T.StringType(), True, {"logical_type": "JSON"}), T.StructField("note", T.StringType()),
    ]
)


def test_random_rows_are_typed_seeded_and_independent_of_partitions(spark):
    df = G.random_rows(spark, SCHEMA, 200, seed=1)
    assert df.dtypes == [(f.name, f.dataType.simpleString()) for f in SCHEMA.fields]
    first = rows(df)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        assert rows(G.random_rows(spark, SCHEMA, 200, seed=1)) == first
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert rows(G.random_rows(spark, SCHEMA, 200, seed=2)) != first
    got = df.collect()
    assert sorted(r["id"] for r in got) == list(range(1, 201))
    assert all(None not in tuple(r) for r in got)
    assert all(0 <= r["tiny"] < 100 and 0 <= r["small"] < 10_000 and len(r["raw"]) == 32 for r in got)
    first_day = dt.date.fromisoformat(G.FIRST_DAY)
    assert all(0 <= (r["day"] - first_day).days < G.DAYS and 0 <= (r["at"].date() - first_day).days < G.DAYS for r in got)
    assert max(r["wide"] for r in got) > 10**36 and max(r["money"] for r in got) > 10**7
    assert all(r["status"] in G.STATES and r["type_code"].isupper() and len(r["type_code"]) == 3 for r in got)
    assert len({r["email"] for r in got}) > 50 and all("@" in r["email"] for r in got)
    assert all(set(json.loads(r["js"])) == {"word", "number"} for r in got)
    assert G.random_rows(spark, SCHEMA, 0).count() == 0


def test_random_rows_of_keys_and_nested_types(spark):
    schema = T.StructType(
        [
            T.StructField("order_id", T.LongType()),
            T.StructField("tags", T.ArrayType(T.StringType())),
            T.StructField("place", T.StructType([T.StructField("x", T.DoubleType()), T.StructField("city", T.StringType())])),
        ]
    )
    got = G.random_rows(spark, schema, 50).collect()
    assert sorted(r["order_id"] for r in got) == list(range(1, 51))
    assert {len(r["tags"]) for r in got} == {1, 2, 3} and all(None not in tuple(r["place"]) for r in got)
    with pytest.raises(TypeError, match="no random values"):
        G.random_rows(spark, T.StructType([T.StructField("m", T.MapType(T.StringType(), T.StringType()))]), 1)


def test_run_record_of_success_and_failure(spark, tmp_path):
    ok = run_step("s", spark.range(10), lambda d: d.where("id > 3"), lambda d: d.write.parquet(str(tmp_path / "o"))).first()
    assert (ok["status"], ok["rows_read"], ok["rows_written"], ok["error"]) == ("success", 10, 6, None)
    bad = run_step("s", spark.range(3), lambda d: d.select("nope"), lambda d: d.count()).first()
    assert bad["status"] == "failed" and "nope" in bad["error"]


def test_transform_steps(spark):
    df = spark.createDataFrame([("1", None), ("x", "b")], "Num string, txt string")
    assert R.rename_snake(df).columns == ["num", "txt"]
    assert R.map_columns(df, {"n": "Num"}).columns == ["n"]
    assert rows(R.standardise_types(df, {"Num": "int"})) == sorted([(1, None), (None, "b")], key=repr)
    assert rows(R.fill_defaults(df, {"txt": "-"})) == [("1", "-"), ("x", "b")]
    rules = [R.SqlRule("SELECT n + 1 AS n FROM {input}", 2), R.SqlRule("SELECT try_cast(Num AS int) AS n FROM {input}", 1)]
    assert rows(R.apply_sql_rules(df, rules)) == sorted([(2,), (None,)], key=repr)


def test_layer_run_is_idempotent_and_keeps_other_days(spark, tmp_path):
    plan = P.LayerPlan(("id",), "ts", ("kind",), (F.count("*").alias("n"),), ("kind", "n"))
    source = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "b", 1)], "id int, kind string, ts int")
    folder = str(tmp_path / "wh")
    for day in ("2024-01-01", "2024-01-02", "2024-01-02"):
        paths = P.run_day(source, plan, "2024-01-03 00:00:00", day, folder)
    ads = spark.read.schema("kind string, n bigint, dt string").parquet(paths["ADS"])
    assert rows(ads) == [("b", 2, "2024-01-01"), ("b", 2, "2024-01-02")]


def event_plan():
    return P.LayerPlan(("id",), "ts", ("kind",), (F.count("*").alias("n"),), ("kind", "n"))


def written(spark, paths):
    return {layer: {str(r["dt"]) for r in spark.read.format(W.LAYER_STORAGE[layer].file_format).load(path).select(F.col("dt").cast("string").alias("dt")).collect()} for layer, path in paths.items()}


def test_dates_with_odd_names_are_replaced_and_removed(spark, tmp_path):
    source = spark.createDataFrame([(1, "a", 1)], "id int, kind string, ts int")
    for date in ("2024-01-01 10:00", "a/b=c%d"):
        folder = str(tmp_path / f"odd-{len(date)}")
        paths = P.run_day(source, event_plan(), "2024-01-03 00:00:00", date, folder)
        assert all(dates == {date} for dates in written(spark, paths).values())
        P.run_day(source, event_plan(), "2024-01-03 00:00:00", date, folder)
        P.run_day(source.limit(0), event_plan(), "2024-01-03 00:00:00", date, folder)
        assert all(not any("dt=" in str(p) for p in (tmp_path / f"odd-{len(date)}" / layer.lower()).iterdir()) for layer in paths)


def test_written_backfill_is_repeated_resumed_and_cleared(spark, tmp_path):
    kind, folder = "id int, kind string, ts timestamp_ntz", str(tmp_path / "wh")
    day = lambda n, hour=3: dt.datetime(2024, 1, n, hour)
    source = spark.createDataFrame([(1, "a", day(1)), (1, "b", day(2)), (2, "b", day(2, 4)), (2, "c", day(4)), (9, "z", day(9))], kind)
    run = lambda rows, name: P.run_backfill(rows, event_plan(), "2024-02-01 00:00:00", "ts", "2024-01-01", "2024-01-05", folder, name)
    paths = run(source, "one")
    ads = lambda: rows(spark.read.schema("kind string, n bigint, dt string").parquet(paths["ADS"]))
    want = [("a", 1, "2024-01-01"), ("b", 2, "2024-01-02"), ("c", 1, "2024-01-04")]
    assert ads() == want
    files = lambda: sorted(str(p) for p in (tmp_path / "wh").rglob("part-*") if "_ledger" not in str(p))
    before = files()
    run(source, "one")  # done already: nothing is written
    assert files() == before
    P.run_day(source, event_plan(), "2024-02-01 00:00:00", "2024-01-09", folder)  # outside of the range
    # Killed between two layers: the same run goes on where it stopped, with what it has written.
    real, calls = P._write_dates, []

    def dies(rows_, layer, *args):
        calls.append(layer)
        if calls == ["ODS", "DWD", "DWS"]:
            raise RuntimeError("killed")
        real(rows_, layer, *args)

    P._write_dates = dies
    later = source.where("ts <> timestamp_ntz'2024-01-04 03:00:00'")  # the fourth is empty now
    try:
        with pytest.raises(RuntimeError):
            run(later, "two")
        assert ads() == sorted([*want, *[r for r in ads() if r[2] == "2024-01-09"]])
        run(later, "two")
    finally:
        P._write_dates = real
    assert calls == ["ODS", "DWD", "DWS", "DWS", "ADS"]
    assert [r for r in ads() if r[2] < "2024-01-09"] == want[:2]
    assert all(dates == {"2024-01-01", "2024-01-02", "2024-01-09"} for dates in written(spark, paths).values())


EVENTS = "event_id int, user_id int, ts timestamp_ntz, kind string"


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1, hour, minute)


def drop(spark, folder, data):
    spark.createDataFrame(data, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_ingest_reads_each_file_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = spark.createDataFrame([], EVENTS).schema
    for i in range(2):
        drop(spark, src, [(i, 1, at(1 + i), "a")])
        for _ in range(2):  # a second run finds nothing new
            S.ingest(S.file_stream(spark, src, schema), out, mark, "2024-01-02 00:00:00", "ts")
    assert rows(spark.read.parquet(out).select("event_id")) == [(0,), (1,)]


def test_late_rows_do_not_reopen_a_window(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = spark.createDataFrame([], EVENTS).schema

    def run():
        stream = S.file_stream(spark, src, schema)
        S.append_to(S.rollup(stream, "ts", "1 hour", ["kind"], [F.count("*").alias("n")], "10 minutes"), out, mark)

    drop(spark, src, [(1, 1, at(1, 5), "a"), (2, 1, at(1, 50), "a"), (3, 1, at(3), "a")])
    run()
    drop(spark, src, [(4, 1, at(1, 30), "a"), (5, 1, at(3, 30), "a"), (6, 1, at(6), "a")])
    run()
    got = rows(spark.read.parquet(out).select(F.hour("window_start"), "kind", "n"))
    assert got == [(1, "a", 2), (3, "a", 2)]  # the late row of 1:30 is dropped, the window of 6:00 is still open


def test_dedup_within_the_watermark(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = spark.createDataFrame([], EVENTS).schema

    def run():
        S.append_to(S.deduplicate(S.file_stream(spark, src, schema), ["event_id"], "ts", "1 hour").select("event_id"), out, mark)

    drop(spark, src, [(1, 1, at(1), "a"), (1, 1, at(1), "a"), (2, 1, at(1, 10), "a")])
    run()
    drop(spark, src, [(1, 1, at(1), "a"), (3, 1, at(1, 20), "a")])
    run()
    assert rows(spark.read.parquet(out)) == [(1,), (2,), (3,)]


def test_stream_upsert_over_several_batches(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = spark.createDataFrame([], EVENTS).schema
    for batch in ([(1, 7, at(5), "new")], [(2, 7, at(4), "old"), (3, 8, at(1), "x")], [(4, 8, at(2), "y")]):
        drop(spark, src, batch)
        stream = S.file_stream(spark, src, schema, files_per_batch=1).withColumn("dt", F.date_format("ts", "yyyy-MM-dd"))
        S.upsert_into(stream, out, mark, ["user_id", "dt"], "dt", "ts")
    assert rows(spark.read.parquet(out).select("user_id", "kind")) == [(7, "new"), (8, "y")]


def test_stream_upsert_skips_what_it_applied_and_frees_its_scratch(spark, tmp_path, monkeypatch):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = spark.createDataFrame([], EVENTS).schema
    given = {"once": lambda: S.file_stream(spark, src, schema, files_per_batch=1).withColumn("dt", F.date_format("ts", "yyyy-MM-dd"))}
    made = len(session._made)
    for n in range(3):
        drop(spark, src, [(n, 7, at(n + 1), f"v{n}")])
        S.upsert_into(given["once"](), out, mark, ["user_id", "dt"], "dt", "ts")
    assert len(session._made) == made and [p.name for p in (tmp_path / "mark" / "applied").iterdir() if p.name[0] != "."] == ["batch-2"]
    calls = []
    monkeypatch.setattr(S, "upsert_partitions", lambda *a, **k: calls.append(a))
    for note in (tmp_path / "mark" / "commits").glob("*2*"):  # as if the job had died before it noted the batch
        note.unlink()
    S.upsert_into(given["once"](), out, mark, ["user_id", "dt"], "dt", "ts")
    assert calls == []
    assert rows(spark.read.parquet(out).select("kind")) == [("v2",)]


def test_scratch_folder_is_the_configured_one(spark):
    assert session.scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    df = session.materialize(spark.range(3), "probe")
    assert df.count() == 3 and session.scratch_dir(spark) in df.inputFiles()[0]
    assert session.release_scratch(spark) >= 1


def test_worker_functions_travel_with_the_job():
    from pyspark import cloudpickle

    from lakestrata.operators.similarity import _unit

    assert b"linalg" in cloudpickle.dumps(_unit)  # pickled by value, not by name
