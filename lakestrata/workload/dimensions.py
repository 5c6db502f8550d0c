"""Dimension histories, the calendar and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakestrata.functions import numeric as N
from lakestrata.operators import dims as D
from lakestrata.sources.write import LAYER_STORAGE
from lakestrata.workload import query


def _versions_sql(source: str) -> str:
    return f"""
    settled AS (SELECT * FROM (SELECT o_custkey, o_orderdate, o_orderpriority,
                  ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS rn FROM {source}) WHERE rn = 1),
    marked AS (SELECT *, LAG(o_orderpriority) OVER w AS before, ROW_NUMBER() OVER w AS pos FROM settled
               WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)),
    versions AS (SELECT o_custkey, o_orderpriority, o_orderdate AS valid_from,
                   LEAD(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS valid_to
                 FROM marked WHERE pos = 1 OR before IS DISTINCT FROM o_orderpriority)
    """


def _printed(df):
    return df.withColumn("valid_from", N.day_key("valid_from")).withColumn("valid_to", F.coalesce(N.day_key("valid_to"), F.lit("")))


def _history(orders):
    return D.scd2_from_history(
        orders, ["o_custkey"], ["o_orderpriority"], "o_orderdate", ["o_orderkey"]
    )


@query(
    "scd2_history",
    "M2",
    f"""
    WITH {_versions_sql("orders")}
    SELECT o_custkey, o_orderpriority, strftime(valid_from, '%Y-%m-%d') AS valid_from,
           COALESCE(strftime(valid_to, '%Y-%m-%d'), '') AS valid_to, valid_to IS NULL AS is_current FROM versions
    """,
)
def scd2_history(t):
    return _printed(_history(t.orders))


@query(
    "scd2_incremental",
    "M2",
    f"""
    WITH early AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'),
    {_versions_sql("early")},
    late AS (SELECT * FROM (SELECT o_custkey, o_orderpriority AS np, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
             FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01') WHERE rn = 1),
    result AS (
      SELECT o_custkey, o_orderpriority, valid_from, valid_to FROM versions WHERE valid_to IS NOT NULL
      UNION ALL
      SELECT v.o_custkey, v.o_orderpriority, v.valid_from,
             CASE WHEN l.np IS NOT NULL AND l.np <> v.o_orderpriority THEN TIMESTAMP '2002-01-01' END
      FROM versions v LEFT JOIN late l USING (o_custkey) WHERE v.valid_to IS NULL
      UNION ALL
      SELECT l.o_custkey, l.np, TIMESTAMP '2002-01-01', NULL
      FROM late l LEFT JOIN (SELECT * FROM versions WHERE valid_to IS NULL) v USING (o_custkey)
      WHERE v.o_custkey IS NULL OR v.o_orderpriority <> l.np)
    SELECT o_custkey, o_orderpriority, strftime(valid_from, '%Y-%m-%d') AS valid_from,
           COALESCE(strftime(valid_to, '%Y-%m-%d'), '') AS valid_to, valid_to IS NULL AS is_current FROM result
    """,
)
def scd2_incremental(t):
    cutoff = F.to_timestamp_ntz(F.lit("1999-01-01"))
    dimension = _history(t.orders.where(F.col("o_orderdate") < cutoff))
    late = t.orders.where(F.col("o_orderdate") >= cutoff)
    latest = late.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("o_orderpriority"))
    return _printed(D.scd2_apply(dimension, latest, ["o_custkey"], ["o_orderpriority"], F.lit("2002-01-01")))


@query(
    "scd2_late_changes",
    "M2",
    f"""
    WITH keyed AS (SELECT NULLIF(o_custkey, 7) AS o_custkey, o_orderkey, o_orderdate, o_orderpriority, o_orderstatus FROM orders),
    closed AS (SELECT * FROM keyed WHERE o_orderstatus = 'F'),
    {_versions_sql("closed")},
    late AS (SELECT o_custkey, o_orderdate, o_orderpriority FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS rn
             FROM keyed WHERE o_orderstatus <> 'F') WHERE rn = 1),
    points AS (SELECT o_custkey, o_orderdate AS since, o_orderpriority AS p, 2 AS rk FROM late UNION ALL SELECT o_custkey, valid_from, o_orderpriority, 1 FROM versions),
    top AS (SELECT o_custkey, since, max_by(p, rk) AS p FROM points GROUP BY o_custkey, since),
    steps AS (SELECT *, LAG(p) OVER w AS before, ROW_NUMBER() OVER w AS pos FROM top WINDOW w AS (PARTITION BY o_custkey ORDER BY since)),
    result AS (SELECT o_custkey, p AS o_orderpriority, since AS valid_from, LEAD(since) OVER (PARTITION BY o_custkey ORDER BY since) AS valid_to
               FROM steps WHERE pos = 1 OR before IS DISTINCT FROM p)
    SELECT o_custkey, o_orderpriority, strftime(valid_from, '%Y-%m-%d') AS valid_from,
           COALESCE(strftime(valid_to, '%Y-%m-%d'), '') AS valid_to, valid_to IS NULL AS is_current FROM result
    """,
)
def scd2_late_changes(t):
    """Closed orders make the dimension; all others come later, several a key and mostly for times before its last version, with a null key among them."""
    orders = t.orders.withColumn("o_custkey", F.when(F.col("o_custkey") != 7, F.col("o_custkey")))
    dimension = _history(orders.where("o_orderstatus = 'F'"))
    return _printed(D.scd2_apply(dimension, orders.where("o_orderstatus <> 'F'"), ["o_custkey"], ["o_orderpriority"], F.col("o_orderdate"), ["o_orderkey"]))


@query(
    "scd3_previous_value",
    "M3",
    """
    WITH news AS (SELECT s_suppkey AS k, 'nation_' || s_nationkey AS v FROM supplier UNION ALL
                  SELECT c_custkey + 1000000000, 'SUPPLIER' FROM customer WHERE c_acctbal < 0)
    SELECT COALESCE(c.c_custkey, n.k) AS c_custkey, COALESCE(n.v, c.c_mktsegment) AS c_mktsegment,
           CASE WHEN c.c_custkey IS NOT NULL AND n.k IS NOT NULL AND c.c_mktsegment IS DISTINCT FROM n.v THEN c.c_mktsegment END AS prev_c_mktsegment
    FROM customer c FULL JOIN news n ON c.c_custkey = n.k
    """,
)
def scd3_previous_value(t):
    dimension = t.customer.select("c_custkey", "c_mktsegment", F.lit(None).cast("string").alias("prev_c_mktsegment"))
    moved = t.supplier.select(
        F.col("s_suppkey").alias("c_custkey"), F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("c_mktsegment")
    )
    added = t.customer.where("c_acctbal < 0").select(
        (F.col("c_custkey") + 1_000_000_000).alias("c_custkey"), F.lit("SUPPLIER").alias("c_mktsegment")
    )
    return D.scd3(dimension, moved.unionByName(added), ["c_custkey"], ["c_mktsegment"])


@query(
    "dimension_consolidation",
    "M4",
    """
    SELECT o_custkey, o_orderstatus, o_orderpriority FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderstatus, o_orderpriority) AS rn FROM orders)
    WHERE rn = 1
    """,
)
def dimension_consolidation(t):
    return D.consolidate(t.orders, ["o_custkey"], ["o_orderstatus", "o_orderpriority"], "o_orderdate")


@query(
    "date_dimension",
    "M8",
    """
    WITH d AS (SELECT CAST(UNNEST(generate_series((SELECT MIN(o_orderdate) FROM orders), (SELECT MAX(o_orderdate) FROM orders), INTERVAL 1 DAY)) AS DATE) AS day)
    SELECT strftime(day, '%Y-%m-%d') AS date_key, year(day) AS year, quarter(day) AS quarter, month(day) AS month,
           day(day) AS day_of_month, isodow(day) AS iso_weekday, week(day) AS iso_week, isodow(day) >= 6 AS is_weekend,
           strftime(date_trunc('month', day), '%Y-%m-%d') AS month_start, strftime(last_day(day), '%Y-%m-%d') AS month_end FROM d
    """,
)
def date_dimension(t):
    bounds = t.orders.agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    return D.date_dimension(bounds, "first", "last")


@query(
    "expired_partitions",
    "M5",
    " UNION ALL ".join(
        f"SELECT DISTINCT '{layer}' AS layer, strftime(o_orderdate, '%Y-%m-%d') AS dt FROM orders "
        f"WHERE o_orderdate < TIMESTAMP '2000-06-30' - INTERVAL {days} DAYS"
        for layer, days in [("ODS", 90), ("DWD", 365), ("DWS", 730), ("TMP", 7)]
    ),
)
def expired_partitions(t):
    partitions = t.orders.select(N.day_key("o_orderdate").alias("dt")).distinct()
    parts = [
        D.expired_partitions(partitions, "2000-06-30", storage.retention_days).select(F.lit(layer).alias("layer"), "dt")
        for layer, storage in LAYER_STORAGE.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
