"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakestrata.functions import numeric as N
from lakestrata.operators import quality as Q
from lakestrata.workload import query

_CHECKS = [
    Q.Check("ship_date_known", "null_check", ("l_shipdate",)),
    Q.Check("discount_small", "range_check", ("l_discount",), low=0.0, high=0.05, threshold=0.5, action="warn"),
    Q.Check("line_unique", "uniqueness", ("l_orderkey", "l_linenumber"), threshold=0.1, action="skip"),
    Q.Check("price_covers_quantity", "expression", (), "l_extendedprice >= l_quantity * 100", threshold=0.2, action="warn"),
]


def _report(rows: list[tuple[str, str, str, float, str, str]]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{i}' AS check_id, '{k}' AS check_type, '{c}' AS column_name, CAST({t} AS DOUBLE) AS threshold, '{a}' AS action, "
        f"(SELECT COUNT(*) FROM lineitem) AS total, CAST(({f}) AS BIGINT) AS failed"
        for i, k, c, t, a, f in rows
    )
    return f"SELECT *, failed::DOUBLE / total AS failed_rate, failed::DOUBLE / total <= threshold AS passed FROM ({parts})"


@query(
    "quality_report",
    "Q1 Q2 Q3 Q4",
    _report(
        [
            ("ship_date_known", "null_check", "l_shipdate", 0, "fail", "SELECT COUNT(*) FROM lineitem WHERE l_shipdate IS NULL"),
            ("discount_small", "range_check", "l_discount", 0.5, "warn", "SELECT COUNT(*) FROM lineitem WHERE NOT COALESCE(l_discount BETWEEN 0 AND 0.05::DOUBLE, FALSE)"),
            ("line_unique", "uniqueness", "l_orderkey,l_linenumber", 0.1, "skip", "SELECT SUM(n) FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE n > 1"),
            ("price_covers_quantity", "expression", "", 0.2, "warn", "SELECT COUNT(*) FROM lineitem WHERE NOT COALESCE(l_extendedprice >= l_quantity * 100, FALSE)"),
        ]
    ),
)
def quality_report(t):
    return Q.run_checks(t.lineitem, _CHECKS)


@query(
    "duplicate_lines",
    "Q3",
    "SELECT l_orderkey, l_linenumber, COUNT(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1",
)
def duplicate_lines(t):
    return Q.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "convention_data_checks",
    "Q5 Q6",
    """
    WITH x AS (SELECT event_id, user_id, value AS amount, value / 10 AS rate FROM events),
         c AS (SELECT COUNT(*) AS total, COUNT_IF(event_id IS NULL) AS n1, COUNT_IF(user_id IS NULL) AS n2,
                 COUNT_IF(NOT COALESCE(amount >= 0, FALSE)) AS n3, COUNT_IF(NOT COALESCE(rate >= 0 AND rate <= 1, FALSE)) AS n4 FROM x)
    SELECT 'not_null.event_id' AS check_id, total, CAST(n1 AS BIGINT) AS failed, n1 = 0 AS passed FROM c
    UNION ALL SELECT 'not_null.user_id', total, CAST(n2 AS BIGINT), n2 = 0 FROM c
    UNION ALL SELECT 'check.amount.amount', total, CAST(n3 AS BIGINT), n3 = 0 FROM c
    UNION ALL SELECT 'check.rate.rate', total, CAST(n4 AS BIGINT), n4 = 0 FROM c
    """,
)
def convention_data_checks(t):
    named = t.events.select("event_id", "user_id", F.col("value").alias("amount"), (F.col("value") / 10).alias("rate"))
    checks = Q.not_null_checks(named.columns) + Q.convention_checks(named.columns)
    return Q.run_checks(named, checks).select("check_id", "total", "failed", "passed")


@query(
    "quarantine_split",
    "Q10 Q3",
    """
    WITH n AS (SELECT *, COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS c FROM lineitem)
    SELECT CASE WHEN c > 1 THEN 'quarantined' ELSE 'passing' END AS side, COUNT(*) AS n_rows,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM n GROUP BY 1
    """,
)
def quarantine_split(t):
    passing, held = Q.enforce(t.lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_extendedprice"), [_CHECKS[1], _CHECKS[2]])
    both = passing.withColumn("side", F.lit("passing")).unionByName(held.withColumn("side", F.lit("quarantined")))
    return both.groupBy("side").agg(F.count("*").alias("n_rows"), N.as_double(F.sum(N.money("l_extendedprice"))).alias("amount"))


@query(
    "summary_reconciliation",
    "Q11",
    """
    SELECT 'l_quantity' AS measure, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS detail_total,
           CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS summary_total, TRUE AS balanced FROM lineitem
    UNION ALL
    SELECT 'l_tax', CAST(SUM(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE),
           (SELECT CAST(SUM(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) FROM lineitem WHERE l_returnflag <> 'A'), FALSE FROM lineitem
    """,
)
def summary_reconciliation(t):
    lines = t.lineitem.withColumn("l_quantity", N.money("l_quantity")).withColumn("l_tax", N.money("l_tax"))
    kept_tax = F.when(F.col("l_returnflag") != "A", F.col("l_tax"))
    summary = lines.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("qty"), F.sum(kept_tax).alias("tax"))
    result = Q.reconcile(lines, summary, {"l_quantity": "qty", "l_tax": "tax"})
    return result.withColumn("detail_total", N.as_double(F.col("detail_total"))).withColumn(
        "summary_total", N.as_double(F.col("summary_total"))
    )


@query(
    "table_expectations",
    "Q7 Q8 Q9",
    """
    SELECT (SELECT COUNT(*) FROM orders) > 0 AS produced, '' AS row_problem, 'missing columns: nope' AS column_problem,
           'absent' AS missing_in_query, COUNT(*) AS n_rows FROM orders
    """,
)
def table_expectations(t):
    t.orders.createOrReplaceTempView("lakestrata_expected")
    counted = t.orders.agg(F.count("*").alias("n_rows"))
    rows = counted.first()["n_rows"]
    row_problem = "; ".join(Q.verify_table(t.orders, rows, ["o_orderkey"]))
    column_problem = "; ".join(Q.verify_table(t.orders, None, ["o_orderkey", "nope"]))
    missing = ",".join(Q.verify_query(t.spark, "SELECT O_ORDERKEY FROM lakestrata_expected", ["o_orderkey", "absent"]))
    return counted.select(
        F.lit(Q.produced_rows(t.orders)).alias("produced"),
        F.lit(row_problem).alias("row_problem"),
        F.lit(column_problem).alias("column_problem"),
        F.lit(missing).alias("missing_in_query"),
        "n_rows",
    )
