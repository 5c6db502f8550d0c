"""Extraction, load strategies, exports and generated rows."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestrata.functions import numeric as N
from lakestrata.operators import load as L
from lakestrata.plans.run_log import run_step
from lakestrata.sources import extract as X
from lakestrata.sources import generate as G
from lakestrata.sources import write as W
from lakestrata.session import materialize, scratch_path
from lakestrata.workload import query


@query(
    "extract_full",
    "S3 S2",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 50000",
)
def extract_full(t):
    return X.extract_full(t.orders, ["o_orderkey", "o_totalprice"], ["o_orderstatus = 'O'", "o_totalprice > 50000"])


@query(
    "extract_incremental",
    "S4",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01'",
)
def extract_incremental(t):
    from datetime import datetime

    fresh, _ = X.extract_incremental(t.orders, "o_orderdate", datetime(2000, 1, 1))
    return fresh.select("o_orderkey", N.day_key("o_orderdate").alias("order_date"))


@query(
    "next_watermark",
    "S4",
    "SELECT strftime(MAX(o_orderdate), '%Y-%m-%d') AS watermark FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01'",
)
def next_watermark(t):
    from datetime import datetime

    _, mark = X.extract_incremental(t.orders, "o_orderdate", datetime(2000, 1, 1))
    return mark.select(N.day_key("watermark").alias("watermark"))


@query("extract_snapshot", "S5", "SELECT *, '2024-01-31' AS dt FROM customer")
def extract_snapshot(t):
    return X.extract_snapshot(t.customer, "2024-01-31")


@query(
    "extract_cdc",
    "S6",
    """
    WITH log AS (SELECT o_custkey, o_orderkey AS seq, CASE o_orderstatus WHEN 'O' THEN 'I' WHEN 'F' THEN 'U' ELSE 'D' END AS op,
                   o_totalprice FROM orders),
         r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY seq DESC) AS rn FROM log)
    SELECT o_custkey, o_totalprice FROM r WHERE rn = 1 AND op <> 'D'
    """,
)
def extract_cdc(t):
    op = F.when(F.col("o_orderstatus") == "O", "I").when(F.col("o_orderstatus") == "F", "U").otherwise("D")
    log = t.orders.select("o_custkey", F.col("o_orderkey").alias("seq"), op.alias("op"), "o_totalprice")
    return X.extract_cdc(log, ["o_custkey"], "seq", "op")


@contextmanager
def _table(t, label: str, rows, partition_by=()):
    """A catalog table of its own for the time of a query, in the scratch folder."""
    name = f"lakestrata_{label}_{uuid.uuid4().hex[:8]}"
    rows.write.partitionBy(*partition_by).option("path", scratch_path(t.spark, label)).saveAsTable(name)
    try:
        yield name
    finally:
        t.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _copied(t, name: str):
    """The rows that a table holds now, written out: the table is dropped before they are read."""
    return materialize(t.spark.table(name), "table")


# The change set: suppliers arrive as customers, and building customers get a new balance.
_CHANGES = """
    src AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1000 AS c_acctbal, c_mktsegment, c_acctbal < 0 AS gone
              FROM customer WHERE c_mktsegment = 'BUILDING'
            UNION ALL SELECT s_suppkey + 1000000000, s_name, s_nationkey, s_acctbal, 'SUPPLIER', s_acctbal < 0 FROM supplier)
"""


def _changes(t):
    moved = t.customer.where("c_mktsegment = 'BUILDING'").select(
        "c_custkey", "c_name", "c_nationkey", (F.col("c_acctbal") + 1000).alias("c_acctbal"), "c_mktsegment", (F.col("c_acctbal") < 0).alias("gone")
    )
    arrived = t.supplier.select(
        (F.col("s_suppkey") + 1_000_000_000).alias("c_custkey"),
        F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"),
        F.col("s_acctbal").alias("c_acctbal"),
        F.lit("SUPPLIER").alias("c_mktsegment"),
        (F.col("s_acctbal") < 0).alias("gone"),
    )
    return moved.unionByName(arrived)


_UPSERTED = f"""
    WITH {_CHANGES}
    SELECT * FROM customer c WHERE NOT EXISTS (SELECT 1 FROM src WHERE src.c_custkey = c.c_custkey)
    UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM src
"""


@query("upsert_customers", "S16 M1", _UPSERTED)
def upsert_customers(t):
    return L.upsert(t.customer, _changes(t), ["c_custkey"])


@query(
    "merge_customers",
    "S17",
    f"""
    WITH {_CHANGES}
    SELECT COALESCE(c.c_custkey, s.c_custkey) AS c_custkey, COALESCE(c.c_name, s.c_name) AS c_name,
           COALESCE(c.c_nationkey, s.c_nationkey) AS c_nationkey, COALESCE(s.c_acctbal, c.c_acctbal) AS c_acctbal,
           COALESCE(c.c_mktsegment, s.c_mktsegment) AS c_mktsegment
    FROM customer c FULL JOIN src s ON c.c_custkey = s.c_custkey WHERE NOT COALESCE(s.gone, FALSE)
    """,
)
def merge_customers(t):
    return L.merge(t.customer, _changes(t), ["c_custkey"], ["c_acctbal"], "gone")


@query(
    "append_rows",
    "S14",
    f"""
    WITH {_CHANGES} SELECT * FROM customer UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM src
    """,
)
def append_rows(t):
    changes = _changes(t).select("c_mktsegment", "c_name", "c_custkey", "c_nationkey", "c_acctbal")
    with _table(t, "appended", t.customer) as name:
        L.append_table(changes, name)
        return _copied(t, name)


@query(
    "overwrite_partition",
    "S15",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders
    """,
)
def overwrite_partition(t):
    orders = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    by_code = orders.withColumn("code", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3))
    doubled = by_code.where("code = 1").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    with _table(t, "overwritten", by_code, ["code"]) as name:
        for _ in range(2):
            L.overwrite_partitions(doubled, name, "code", ["01"])
        return _copied(t, name).drop("code")


@query(
    "upsert_partitioned_table",
    "S16 S17",
    f"""
    WITH {_CHANGES}, changed AS (SELECT * FROM src UNION ALL SELECT NULL, 'nobody', NULL, 0, 'NEW', FALSE)
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM changed s WHERE s.c_custkey = c.c_custkey)
    UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN gone THEN 'MOVED' ELSE c_mktsegment END FROM changed
    """,
)
def upsert_partitioned_table(t):
    """Changes that move rows to other partitions, one with a null key, applied twice."""
    changes = _changes(t)
    nobody = t.spark.range(1).select(
        F.lit(None).cast("bigint").alias("c_custkey"), F.lit("nobody").alias("c_name"), F.lit(None).alias("c_nationkey"), F.lit(0.0).alias("c_acctbal"),
        F.lit("NEW").alias("c_mktsegment"), F.lit(False).alias("gone"),
    )
    moved = changes.unionByName(nobody).withColumn("c_mktsegment", F.when(F.col("gone"), "MOVED").otherwise(F.col("c_mktsegment"))).drop("gone")
    with _table(t, "upserted", t.customer, ["c_mktsegment"]) as name:
        for _ in range(2):
            L.upsert_table(moved, name, ["c_custkey"])
        return _copied(t, name).select(*t.customer.columns)


@query("replace_rows", "S18", "SELECT s_suppkey, s_name FROM supplier")
def replace_rows(t):
    path = scratch_path(t.spark, "replace")
    W.export_parquet(t.customer.select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name")), path)
    rows = t.supplier.select("s_suppkey", "s_name")
    W.export_parquet(rows, path, "overwrite")
    return t.spark.read.schema(rows.schema).parquet(path)


@query(
    "upsert_partitions",
    "S16",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 100000 THEN 0 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders
    """,
)
def upsert_partitions(t):
    path = scratch_path(t.spark, "upsert")
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    W.write_layer(rows, "DWD", path, ["o_orderstatus"])
    changed = rows.where("o_orderstatus = 'P' AND o_totalprice > 100000").withColumn("o_totalprice", F.lit(0.0))
    L.upsert_partitions(changed, path, ["o_orderkey", "o_orderstatus"], "o_orderstatus")
    return t.spark.read.schema(rows.schema).parquet(path)


@query("csv_round_trip", "S7 S10", "SELECT doc_id, n_chars, text, CASE WHEN doc_id % 3 > 0 THEN lang END AS lang FROM documents")
def csv_round_trip(t):
    """Whole texts with line breaks, quotes and blanks, and null cells."""
    path = scratch_path(t.spark, "csv")
    W.export_csv(t.documents.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang"))), path)
    kinds = {"doc_id": T.LongType(), "n_chars": T.LongType(), "text": T.StringType(), "lang": T.StringType()}
    good, _ = X.read_csv_checked(t.spark, path, T.StructType([T.StructField(c, k) for c, k in kinds.items()]))
    return good


@query("parquet_round_trip", "S9", "SELECT p_partkey, p_brand, p_retailprice FROM part")
def parquet_round_trip(t):
    path = scratch_path(t.spark, "parquet")
    rows = t.part.select("p_partkey", "p_brand", "p_retailprice")
    W.export_parquet(rows, path)
    return t.spark.read.schema(rows.schema).parquet(path)


@query("orc_layer_storage", "S11", "SELECT c_custkey, c_name, c_mktsegment AS dt FROM customer")
def orc_layer_storage(t):
    path = scratch_path(t.spark, "ods")
    rows = t.customer.select("c_custkey", "c_name", F.col("c_mktsegment").alias("dt"))
    W.write_layer(rows, "ODS", path)
    return t.spark.read.format("orc").schema(rows.schema).load(path)


@query(
    "materialised_query",
    "S12 S13 A6",
    """
    SELECT o_orderpriority, COUNT(*) AS n_orders, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
    FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority
    """,
)
def materialised_query(t):
    t.orders.createOrReplaceTempView("lakestrata_orders")
    W.create_view(t.spark, "lakestrata_closed", "SELECT * FROM lakestrata_orders WHERE o_orderstatus = 'F'")
    sql = """
        SELECT o_orderpriority, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
        FROM lakestrata_closed GROUP BY o_orderpriority
    """
    name = f"ads_priority_sales_{uuid.uuid4().hex[:8]}"
    W.create_table_as(t.spark, name, sql, "closed orders by priority", scratch_path(t.spark, "ctas"))
    try:
        return _copied(t, name)
    finally:
        t.spark.sql(f"DROP TABLE {name}")


@query(
    "run_metrics",
    "M9",
    """
    SELECT 'closed_orders' AS step, 'success' AS status, COUNT(*) AS rows_read,
           CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS rows_written FROM orders
    """,
)
def run_metrics(t):
    path = scratch_path(t.spark, "run")
    record = run_step("closed_orders", t.orders, lambda df: df.where("o_orderstatus = 'F'"), lambda df: W.export_parquet(df, path))
    return record.select("step", "status", "rows_read", "rows_written")


@query(
    "generated_sequence",
    "S20",
    """
    SELECT i + 1 AS id, (i + 1) * 1.5::DOUBLE AS amount, i % 2 = 0 AS active,
           '2025-01-' || lpad(CAST(i % 28 + 1 AS VARCHAR), 2, '0') AS day, 'sample_label_' || (i + 1) AS label,
           '{"id": ' || (i + 1) || '}' AS payload
    FROM range((SELECT COUNT(*) FROM orders)) r(i)
    """,
)
def generated_sequence(t):
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("amount", T.DoubleType()),
            T.StructField("active", T.BooleanType()),
            T.StructField("day", T.DateType()),
            T.StructField("label", T.StringType()),
            T.StructField("payload", T.StringType(), True, {"logical_type": "JSON"}),
        ]
    )
    return G.deterministic_rows(t.spark, schema, t.orders.count()).withColumn("day", N.day_key("day"))


@query("generated_random", "S19")
def generated_random(t):
    """As many random rows as there are customers, with the columns of that table."""
    return G.random_rows(t.spark, t.customer.schema, t.customer.count())


@query(
    "generated_random_facts",
    "S19",
    """
    SELECT COUNT(*) AS n, COUNT(*) AS n_keys, 1::BIGINT AS least_key, COUNT(*) AS greatest_key,
           0::BIGINT AS n_nulls, 0::BIGINT AS n_shapeless, 0::BIGINT AS n_changed FROM customer
    """,
)
def generated_random_facts(t):
    """What must hold of any seed: keys count up, names and segments have their shapes, other partitions make the same rows."""
    n = t.customer.count()
    made = G.random_rows(t.spark, t.customer.schema, n)
    again = G.random_rows(t.spark, t.customer.schema, n).repartition(7, "c_custkey")
    null = F.greatest(*(F.col(c).isNull().cast("long") for c in made.columns))
    shapeless = ~F.col("c_name").rlike("^[A-Z][a-z]+ [A-Z][a-z]+$") | ~F.col("c_mktsegment").rlike("^[A-Z][0-9]{2}$")
    facts = made.agg(
        F.count("*").alias("n"),
        F.count_distinct("c_custkey").alias("n_keys"),
        F.coalesce(F.min("c_custkey"), F.lit(1)).cast("long").alias("least_key"),
        F.coalesce(F.max("c_custkey"), F.lit(0)).cast("long").alias("greatest_key"),
        F.coalesce(F.sum(null), F.lit(0)).alias("n_nulls"),
        F.count_if(shapeless).alias("n_shapeless"),
    )
    changed = made.exceptAll(again).agg(F.count("*").alias("n_changed"))
    return facts.join(changed, F.lit(True))
