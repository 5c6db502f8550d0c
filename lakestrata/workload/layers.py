"""Layer jobs and the transforms between layers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestrata.functions import numeric as N
from lakestrata.operators import aggregate as A
from lakestrata.operators import evolve as E
from lakestrata.operators import transform as R
from lakestrata.plans import layered as L
from lakestrata.session import scratch_path
from lakestrata.workload import query

ETL_TIME = "2024-02-01 02:00:00"
BIZDATE = "2024-01-15"
_STAMPS = "strftime(TIMESTAMP '2024-02-01 02:00:00', '%Y-%m-%d %H:%M:%S') AS etl_time"


def _second(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query(
    "ods_events",
    "P1 P3 P4",
    f"""
    SELECT event_id, user_id, event_type, value, 'web' AS source_system, {_STAMPS}, '2024-01-31' AS dt FROM events
    """,
)
def ods_events(t):
    source = t.events.select(
        F.col("event_id").alias("eventId"), F.col("user_id").alias("UserId"), F.col("event_type").alias("event-Type"), "value"
    )
    return L.to_ods(source, ETL_TIME, "2024-01-31", "web").withColumn("etl_time", _second("etl_time"))


@query(
    "dwd_latest_lines",
    "W1 P2 P8",
    """
    WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC NULLS LAST,
                 l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn
               FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS l_quantity, l_extendedprice,
           COALESCE(l_returnflag, 'N') AS l_returnflag, strftime(l_shipdate, '%Y-%m-%d') AS ship_date
    FROM r WHERE rn = 1
    """,
)
def dwd_latest_lines(t):
    ods = L.to_ods(t.lineitem, ETL_TIME, BIZDATE)
    dwd = L.to_dwd(ods, ["l_orderkey", "l_linenumber"], "l_shipdate", {"l_quantity": "bigint"}, {"l_returnflag": "N"})
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"]
    return dwd.select(*columns, N.day_key("l_shipdate").alias("ship_date"))


@query(
    "inferred_rollup",
    "A1",
    """
    SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS o_totalprice, COUNT(o_custkey) AS o_custkey
    FROM orders GROUP BY o_orderstatus, o_orderdate, o_orderpriority
    """,
)
def inferred_rollup(t):
    orders = t.orders.withColumn("o_totalprice", N.money("o_totalprice"))
    summary = A.apply_inferred(orders, A.infer_rollup(orders.schema, ["o_orderkey"]))
    return summary.withColumn("o_totalprice", N.as_double(F.col("o_totalprice"))).withColumn("o_orderdate", N.day_key("o_orderdate"))


def _event_plan():
    return L.LayerPlan(
        keys=("user_id", "event_type"),
        order_column="ts",
        dimensions=("event_type",),
        metrics=(F.count("*").alias("n_users"), F.sum("value").alias("last_value")),
        report=("event_type", "n_users", F.col("last_value").cast("double").alias("last_value")),
        types={"value": "decimal(18,2)"},
        defaults={"value": 0},
    )


_LAST_EVENT = """
    ranked AS (SELECT *, strftime(ts, '%Y-%m-%d') AS dt,
      ROW_NUMBER() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts DESC NULLS LAST, event_id, value, props) AS rn
      FROM events),
    dwd AS (SELECT * FROM ranked WHERE rn = 1)
"""


@query(
    "layer_chain_day",
    "M6 P3 P5 P6 W1 A1",
    f"""
    WITH {_LAST_EVENT}
    SELECT event_type, dt, COUNT(*) AS n_users, CAST(SUM(COALESCE(CAST(value AS DECIMAL(18,2)), 0)) AS DOUBLE) AS last_value
    FROM dwd WHERE dt = '{BIZDATE}' GROUP BY event_type, dt
    """,
)
def layer_chain_day(t):
    return L.backfill(t.events, _event_plan(), ETL_TIME, "ts", BIZDATE, BIZDATE).ads


@query(
    "layer_backfill",
    "M7 M6",
    f"""
    WITH {_LAST_EVENT}
    SELECT event_type, dt, COUNT(*) AS n_users, CAST(SUM(COALESCE(CAST(value AS DECIMAL(18,2)), 0)) AS DOUBLE) AS last_value
    FROM dwd WHERE dt BETWEEN '2024-01-03' AND '2024-01-27' GROUP BY event_type, dt
    """,
)
def layer_backfill(t):
    """Written, run again under another name, and once more under the first one, which writes nothing."""
    folder = scratch_path(t.spark, "backfill")
    for run in ("first", "again", "first"):
        paths = L.run_backfill(t.events, _event_plan(), ETL_TIME, "ts", "2024-01-03", "2024-01-27", folder, run)
    return t.spark.read.schema("event_type string, n_users bigint, last_value double, dt string").parquet(paths["ADS"])


@query(
    "layer_backfill_plan",
    "M7",
    f"""
    WITH {_LAST_EVENT}
    SELECT event_type, dt, COUNT(*) AS n_users, CAST(SUM(COALESCE(CAST(value AS DECIMAL(18,2)), 0)) AS DOUBLE) AS last_value
    FROM dwd WHERE dt BETWEEN '2024-01-03' AND '2024-01-27' GROUP BY event_type, dt
    """,
)
def layer_backfill_plan(t):
    return L.backfill(t.events, _event_plan(), ETL_TIME, "ts", "2024-01-03", "2024-01-27").ads


@query(
    "layer_run_written",
    "M6 S11 S15 P5",
    f"""
    WITH {_LAST_EVENT}
    SELECT event_type, dt, COUNT(*) AS n_users, CAST(SUM(COALESCE(CAST(value AS DECIMAL(18,2)), 0)) AS DOUBLE) AS last_value
    FROM dwd WHERE dt = '{BIZDATE}' GROUP BY event_type, dt
    """,
)
def layer_run_written(t):
    day = t.events.where((F.col("ts") >= F.to_timestamp_ntz(F.lit(BIZDATE))) & (F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-16"))))
    folder = scratch_path(t.spark, "layers")
    paths = L.run_day(day, _event_plan(), ETL_TIME, BIZDATE, folder)
    stored = t.spark.read.schema("event_type string, n_users bigint, last_value double, dt string").parquet(paths["ADS"])
    return L.on_date(stored, BIZDATE)


@query(
    "cast_failures",
    "P2",
    """
    SELECT 'event_type' AS column_name, 'bigint' AS target_type,
           CAST(SUM(CASE WHEN event_type IS NOT NULL AND TRY_CAST(event_type AS BIGINT) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM events
    UNION ALL
    SELECT 'value', 'decimal(4,2)', CAST(SUM(CASE WHEN value IS NOT NULL AND TRY_CAST(value AS DECIMAL(4,2)) IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM events
    """,
)
def cast_failures(t):
    return R.cast_failures(t.events, {"event_type": "bigint", "value": "decimal(4,2)"})


@query(
    "null_defaults",
    "P8",
    """
    SELECT o.o_orderkey, COALESCE(c.c_name, 'unknown') AS c_name, COALESCE(c.c_nationkey, -1) AS c_nationkey
    FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0
    """,
)
def null_defaults(t):
    credit = t.customer.where("c_acctbal > 0").select("c_custkey", "c_name", "c_nationkey")
    joined = t.orders.join(credit, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "c_nationkey")
    return R.fill_defaults(joined, {"c_name": "unknown", "c_nationkey": -1})


@query(
    "business_rules",
    "P9",
    """
    SELECT o_orderkey, upper(trim(o_orderpriority)) AS o_orderpriority,
           CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END AS size_class
    FROM orders WHERE o_orderstatus <> 'P'
    """,
)
def business_rules(t):
    rules = [
        R.RowRule("filter", "o_orderstatus <> 'P'"),
        R.RowRule("cleansing", "upper(trim(o_orderpriority))", "o_orderpriority"),
        R.RowRule("derivation", "CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END", "size_class"),
    ]
    return R.apply_row_rules(t.orders, rules).select("o_orderkey", "o_orderpriority", "size_class")


@query(
    "sql_rules",
    "P7 P10",
    """
    SELECT c_mktsegment, COUNT(*) AS n FROM (SELECT * FROM customer WHERE c_acctbal >= 1000) GROUP BY c_mktsegment
    """,
)
def sql_rules(t):
    rules = [
        R.SqlRule("SELECT c_mktsegment, count(*) AS n FROM {input} GROUP BY c_mktsegment", order=2),
        R.SqlRule("SELECT * FROM {input} WHERE c_acctbal >= 1000", order=1),
    ]
    return R.apply_sql_rules(t.customer, rules)


@query(
    "native_function_step",
    "D2 D1",
    "SELECT l_returnflag, COUNT(*) AS n FROM lineitem WHERE l_quantity >= 10 GROUP BY l_returnflag",
)
def native_function_step(t):
    def busy(df, least):
        return df.where(F.col("l_quantity") >= least).groupBy("l_returnflag").agg(F.count("*").alias("n"))

    return R.apply_function(t.lineitem, busy, least=10)


@query(
    "pandas_batch_step",
    "D1",
    "SELECT event_id, CASE WHEN value >= 20 THEN 'high' ELSE 'low' END AS band FROM events",
)
def pandas_batch_step(t):
    def band(batch):
        high = batch["value"] >= 20
        return batch[["event_id"]].assign(band=high.map({True: "high", False: "low"}))

    return R.apply_per_batch(t.events.select("event_id", "value"), band, "event_id bigint, band string")


@query(
    "pandas_group_step",
    "D3",
    """
    WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, MAX(value) AS top FROM events GROUP BY 1, 2),
         g AS (SELECT user_id, MAX(top) AS best FROM d GROUP BY user_id)
    SELECT d.user_id, strftime(d.day, '%Y-%m-%d') AS day, g.best - d.top AS gap FROM d JOIN g USING (user_id)
    """,
)
def pandas_group_step(t):
    def gap(frame):
        return frame.assign(gap=frame["top"].max() - frame["top"])[["user_id", "day", "gap"]]

    # Reduced to one row per user and day first, so a group has at most one row per day.
    daily = t.events.groupBy("user_id", N.day_key("ts").alias("day")).agg(F.max("value").alias("top"))
    return R.apply_per_group(daily, ["user_id"], gap, "user_id bigint, day string, gap double")


@query(
    "conformed_customers",
    "E2",
    """
    SELECT c_custkey AS id, CAST(NULL AS VARCHAR) AS email, TRY_CAST(c_name AS BIGINT) AS c_name,
           'unset' AS tier, CAST(CAST(c_acctbal AS DECIMAL(18,1)) AS DOUBLE) AS balance FROM customer
    """,
)
def conformed_customers(t):
    source = t.customer.select(F.col("c_custkey").cast("string").alias("id"), "c_name", F.col("c_acctbal").alias("balance"), "c_nationkey")
    target = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("email", T.StringType()),
            T.StructField("c_name", T.LongType()),
            T.StructField("tier", T.StringType()),
            T.StructField("balance", T.DecimalType(18, 1)),
        ]
    )
    return E.conform(source, target, {"tier": "unset"}).withColumn("balance", N.as_double(F.col("balance")))


@query(
    "schema_changes",
    "E1 J7",
    """
    WITH a AS (SELECT p_brand AS table_name, p_name || '_' || p_partkey AS column_name,
                 CASE WHEN p_size < 25 THEN 'INT' ELSE 'STRING' END AS data_type, p_type AS comment FROM part WHERE p_type <> 'PROMO'),
         b AS (SELECT p_brand AS table_name, p_name || '_' || p_partkey AS column_name,
                 CASE WHEN p_size < 30 THEN 'INT' ELSE 'STRING' END AS data_type,
                 CASE WHEN p_size > 45 THEN 'new' ELSE p_type END AS comment FROM part WHERE p_type <> 'SMALL' AND p_type <> 'ECONOMY'),
         j AS (SELECT COALESCE(a.table_name, b.table_name) AS table_name, COALESCE(a.column_name, b.column_name) AS column_name,
                 a.data_type AS from_type, b.data_type AS to_type, a.comment AS c0, b.comment AS c1,
                 a.table_name IS NOT NULL AS o, b.table_name IS NOT NULL AS n
               FROM a FULL JOIN b ON a.table_name = b.table_name AND a.column_name = b.column_name)
    SELECT table_name, column_name, 'added' AS change, from_type, to_type FROM j WHERE NOT o
    UNION ALL SELECT table_name, column_name, 'removed', from_type, to_type FROM j WHERE NOT n
    UNION ALL SELECT table_name, column_name, 'type_changed', from_type, to_type FROM j WHERE o AND n AND from_type <> to_type
    UNION ALL SELECT table_name, column_name, 'comment_changed', from_type, to_type FROM j WHERE o AND n AND c0 <> c1 AND c1 <> ''
    """,
)
def schema_changes(t):
    name = F.concat("p_name", F.lit("_"), "p_partkey").alias("column_name")
    table, size = F.col("p_brand").alias("table_name"), F.col("p_size")
    before = t.part.where("p_type <> 'PROMO'").select(
        table, name, F.when(size < 25, "INT").otherwise("STRING").alias("data_type"), F.col("p_type").alias("comment")
    )
    after = t.part.where("p_type <> 'SMALL' AND p_type <> 'ECONOMY'").select(
        table,
        name,
        F.when(size < 30, "INT").otherwise("STRING").alias("data_type"),
        F.when(size > 45, "new").otherwise(F.col("p_type")).alias("comment"),
    )
    return E.diff_schemas(before, after)
