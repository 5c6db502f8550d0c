"""Convention audit of a columns table that the order lines are read as."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakestrata.operators import audit as A
from lakestrata.workload import query

_COLUMNS = """
    cols AS (
      SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'ods_' WHEN '2-HIGH' THEN 'dwd_' WHEN '3-MEDIUM' THEN 'dws_' WHEN '4-NOT SPECIFIED' THEN 'ads_' ELSE 'Order' END
               || CASE WHEN o_totalprice < 50000 THEN 'user_' ELSE 'sales_' END || o_orderkey AS table_name,
             CASE o_orderstatus WHEN 'O' THEN '' WHEN 'F' THEN '[ODS] closed sales' ELSE 'pending' END AS table_comment,
             CASE l_linenumber WHEN 1 THEN 'sales_id' WHEN 2 THEN 'user_key' WHEN 3 THEN 'amount' WHEN 4 THEN 'orderDate' WHEN 5 THEN 'dt' WHEN 6 THEN 'item_sk' ELSE 'note' END AS column_name,
             CASE WHEN l_returnflag = 'A' THEN 'BIGINT' WHEN l_returnflag = 'N' THEN 'DECIMAL(18,2)' WHEN l_quantity < 25 THEN 'text(20)' ELSE 'MONEY' END AS data_type,
             l_linestatus = 'O' AS nullable, l_linenumber = 1 AND l_returnflag = 'A' AS is_primary_key,
             CASE WHEN l_tax = 0 THEN '' WHEN l_tax < 0.03 THEN 'ab' ELSE 'long enough' END AS column_comment,
             CASE WHEN o_totalprice > 300000 THEN ['dt'] WHEN o_totalprice > 200000 THEN ['stat_date'] ELSE CAST([] AS VARCHAR[]) END AS partition_keys,
             CASE o_orderstatus WHEN 'F' THEN 'Parquet' ELSE 'orc' END AS storage_format,
             CASE WHEN o_totalprice > 100000 THEN 'snappy' ELSE 'gzip' END AS compression,
             CASE WHEN o_orderstatus = 'P' THEN 'DWD' ELSE 'ODS' END AS layer
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
"""


def columns_table(t):
    def cases(c, pairs, other):
        chosen = F.when(F.col(c) == pairs[0][0], pairs[0][1])
        for value, result in pairs[1:]:
            chosen = chosen.when(F.col(c) == value, result)
        return chosen.otherwise(other)

    price, tax = F.col("o_totalprice"), F.col("l_tax")
    layers = [("1-URGENT", "ods_"), ("2-HIGH", "dwd_"), ("3-MEDIUM", "dws_"), ("4-NOT SPECIFIED", "ads_")]
    names = [(1, "sales_id"), (2, "user_key"), (3, "amount"), (4, "orderDate"), (5, "dt"), (6, "item_sk")]
    kind = (
        F.when(F.col("l_returnflag") == "A", "BIGINT")
        .when(F.col("l_returnflag") == "N", "DECIMAL(18,2)")
        .when(F.col("l_quantity") < 25, "text(20)")
        .otherwise("MONEY")
    )
    keys = (
        F.when(price > 300000, F.array(F.lit("dt")))
        .when(price > 200000, F.array(F.lit("stat_date")))
        .otherwise(F.array().cast("array<string>"))
    )
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_tax")
    orders = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    middle = F.when(price < 50000, "user_").otherwise("sales_")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(cases("o_orderpriority", layers, "Order"), middle, F.col("o_orderkey").cast("string")).alias("table_name"),
        cases("o_orderstatus", [("O", ""), ("F", "[ODS] closed sales")], "pending").alias("table_comment"),
        cases("l_linenumber", names, "note").alias("column_name"),
        kind.alias("data_type"),
        (F.col("l_linestatus") == "O").alias("nullable"),
        ((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "A")).alias("is_primary_key"),
        F.when(tax == 0, "").when(tax < 0.03, "ab").otherwise("long enough").alias("column_comment"),
        keys.alias("partition_keys"),
        cases("o_orderstatus", [("F", "Parquet")], "orc").alias("storage_format"),
        F.when(price > 100000, "snappy").otherwise("gzip").alias("compression"),
        cases("o_orderstatus", [("P", "DWD")], "ODS").alias("layer"),
    )


_RESERVED = "[" + ", ".join(f"'{w}'" for w in A.RESERVED_WORDS) + "]"
_KNOWN = "('STRING', 'INT', 'BIGINT', 'FLOAT', 'DOUBLE', 'DECIMAL', 'BOOLEAN', 'DATE', 'TIMESTAMP')"
_CASE = "^[a-z][a-z0-9]*(_[a-z0-9]+)*$"
_VIOLATIONS = f"""
    {_COLUMNS},
    x AS (SELECT *, upper(trim(data_type)) AS ty, regexp_split_to_array(upper(trim(data_type)), '[(\\s]')[1] AS base FROM cols),
    t AS (SELECT table_name, MAX(table_comment) AS table_comment, MAX(partition_keys) AS pk, MAX(storage_format) AS sf, MAX(compression) AS cp,
            MAX(layer) AS layer, BOOL_OR(is_primary_key) AS has_key FROM cols GROUP BY table_name),
    d AS (SELECT *, CASE WHEN starts_with(table_name, 'ods_') OR starts_with(table_name, 'dwd_') THEN 'dt'
                         WHEN starts_with(table_name, 'dws_') OR starts_with(table_name, 'ads_') THEN 'stat_date' END AS expected FROM t),
    v AS (
      SELECT table_name, column_name, 'naming.column_case' AS rule, 'warning' AS severity FROM x WHERE NOT regexp_matches(column_name, '{_CASE}')
      UNION ALL SELECT table_name, column_name, 'naming.reserved_word_column', 'error' FROM x
        WHERE list_has_any(regexp_split_to_array(lower(column_name), '[_\\-\\s]+'), {_RESERVED})
      UNION ALL SELECT table_name, column_name, 'datatype.forbidden', 'error' FROM x
        WHERE ty IN ('TEXT', 'BLOB', 'MEDIUMTEXT', 'LONGTEXT', 'MEDIUMBLOB', 'LONGBLOB') OR starts_with(ty, 'TEXT(')
      UNION ALL SELECT table_name, column_name, 'datatype.unknown_for_engine', 'warning' FROM x
        WHERE base NOT IN {_KNOWN} AND base NOT IN ('TEXT', 'BLOB', 'MEDIUMTEXT', 'LONGTEXT', 'MEDIUMBLOB', 'LONGBLOB')
      UNION ALL SELECT table_name, column_name, 'comment.column_required', 'warning' FROM x WHERE trim(column_comment) = ''
      UNION ALL SELECT table_name, column_name, 'comment.column_min_length', 'info' FROM x WHERE column_comment <> '' AND len(trim(column_comment)) < 3
      UNION ALL SELECT table_name, column_name, 'quality.not_null', 'warning' FROM x
        WHERE nullable AND (lower(column_name) LIKE '%\\_id' ESCAPE '\\' OR lower(column_name) LIKE '%\\_key' ESCAPE '\\' OR lower(column_name) IN ('dt', 'etl_time'))
      UNION ALL SELECT table_name, column_name, 'quality.unique_hint', 'info' FROM x WHERE lower(column_name) LIKE '%\\_sk' ESCAPE '\\'
      UNION ALL SELECT table_name, '', 'naming.table_case', 'error' FROM d WHERE NOT regexp_matches(table_name, '{_CASE}')
      UNION ALL SELECT table_name, '', 'naming.table_prefix', 'error' FROM d WHERE NOT starts_with(table_name, lower(layer) || '_')
      UNION ALL SELECT table_name, '', 'naming.reserved_word_table', 'error' FROM d
        WHERE list_has_any(regexp_split_to_array(lower(table_name), '[_\\-\\s]+'), {_RESERVED})
      UNION ALL SELECT table_name, '', 'comment.table_required', 'error' FROM d WHERE trim(table_comment) = ''
      UNION ALL SELECT table_name, '', 'comment.table_pattern', 'warning' FROM d WHERE table_comment <> '' AND NOT regexp_matches(table_comment, '\\[.+\\] .+')
      UNION ALL SELECT table_name, '', 'partition.column_mismatch', 'warning' FROM d WHERE expected IS NOT NULL AND len(pk) > 0 AND NOT list_contains(pk, expected)
      UNION ALL SELECT table_name, '', 'partition.missing', 'info' FROM d WHERE expected IS NOT NULL AND len(pk) = 0
      UNION ALL SELECT table_name, '', 'quality.primary_key_required', 'warning' FROM d WHERE NOT has_key
      UNION ALL SELECT table_name, '', 'storage.format', 'info' FROM d WHERE upper(sf) <> 'ORC'
      UNION ALL SELECT table_name, '', 'storage.compression', 'info' FROM d WHERE upper(cp) <> 'SNAPPY')
"""


@query(
    "convention_violations",
    "C1 C2 C3 C4 C5 C6 C7 C8 C9 C10 C11 C12 C13 F4",
    f"WITH {_VIOLATIONS} SELECT table_name, column_name, rule, severity FROM v",
)
def convention_violations(t):
    return A.violations(columns_table(t))


@query(
    "convention_scores",
    "C14",
    f"""
    WITH {_VIOLATIONS},
    s AS (SELECT t.table_name, COUNT_IF(severity = 'error') AS errors, COUNT_IF(severity = 'warning') AS warnings, COUNT_IF(severity = 'info') AS infos
          FROM t LEFT JOIN v ON v.table_name = t.table_name GROUP BY t.table_name)
    SELECT table_name, CAST(errors AS BIGINT) AS errors, CAST(warnings AS BIGINT) AS warnings, CAST(infos AS BIGINT) AS infos,
           CAST(GREATEST(0, 100 - 15 * errors - 5 * warnings - infos) AS BIGINT) AS score, errors = 0 AS is_valid FROM s
    """,
)
def convention_scores(t):
    return A.scores(columns_table(t))
