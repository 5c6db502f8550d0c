"""Questions asked straight of the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakestrata.functions import numeric as N
from lakestrata.functions import text as X
from lakestrata.operators import aggregate as A
from lakestrata.operators import joins as J
from lakestrata.operators import windows as W
from lakestrata.workload import query


@query(
    "product_sales_month",
    "A6 J1 F1 F2 T3",
    """
    SELECT p.p_partkey AS product_id, p.p_name AS product_name,
           CAST(SUM(CAST(l.l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total_qty,
           CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_amount
    FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey
    WHERE strftime(o.o_orderdate, '%Y-%m') = '1996-06'
    GROUP BY p.p_partkey, p.p_name
    ORDER BY total_amount DESC, product_id
    """,
)
def product_sales_month(t):
    orders = t.orders.where(N.month_range(F.col("o_orderdate"), "1996-06-01")).select("o_orderkey")
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    # Rolled up by product key before the names are fetched.
    sold = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_partkey")
        .agg(F.sum(N.money("l_quantity")).alias("q"), F.sum(N.money("l_extendedprice")).alias("a"))
    )
    named = sold.join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return named.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        N.as_double(F.col("q")).alias("total_qty"),
        N.as_double(F.col("a")).alias("total_amount"),
    ).orderBy(F.desc("total_amount"), "product_id")


@query(
    "spend_by_nation_premium",
    "A7 J2 P15",
    """
    SELECT r.r_name AS region, n.n_name AS nation, COUNT(*) AS n_orders,
           CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend
    FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
    JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
    WHERE c.c_acctbal >= 3000 AND o.o_orderdate >= TIMESTAMP '1996-06-01' AND o.o_orderdate < TIMESTAMP '1996-07-01'
    GROUP BY r.r_name, n.n_name
    """,
)
def spend_by_nation_premium(t):
    # One row per customer before the join, so a customer with a third of the orders is one row.
    per_customer = (
        t.orders.where(N.month_range(F.col("o_orderdate"), "1996-06-01"))
        .groupBy("o_custkey")
        .agg(F.count("*").alias("n"), F.sum(N.money("o_totalprice")).alias("s"))
    )
    premium = t.customer.where(F.col("c_acctbal") >= 3000).select("c_custkey", "c_nationkey")
    return (
        per_customer.join(premium, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation"))
        .agg(F.sum("n").alias("n_orders"), N.as_double(F.sum("s")).alias("spend"))
    )


@query(
    "monthly_revenue",
    "A5 F1",
    """
    SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS order_month,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue
    FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'
    GROUP BY 1
    """,
)
def monthly_revenue(t):
    year = t.orders.where(N.month_range(F.col("o_orderdate"), "1996-01-01", 12))
    return year.groupBy(N.day_key(F.date_trunc("month", "o_orderdate")).alias("order_month")).agg(
        N.as_double(F.sum(N.money("o_totalprice"))).alias("total_revenue")
    )


@query(
    "month_total",
    "A8",
    """
    SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_amount, COUNT(*) AS n_orders
    FROM orders WHERE o_orderdate >= TIMESTAMP '1997-05-01' AND o_orderdate < TIMESTAMP '1997-06-01'
    """,
)
def month_total(t):
    month = t.orders.where(N.month_range(F.col("o_orderdate"), "1997-05-01"))
    return month.agg(N.as_double(F.sum(N.money("o_totalprice"))).alias("total_amount"), F.count("*").alias("n_orders"))


@query(
    "daily_active_users",
    "A9",
    """
    SELECT strftime(ts, '%Y-%m-%d') AS stat_date, COUNT(DISTINCT user_id) AS active_users
    FROM events GROUP BY 1
    """,
)
def daily_active_users(t):
    return t.events.groupBy(N.day_key("ts").alias("stat_date")).agg(F.count_distinct("user_id").alias("active_users"))


@query(
    "daily_sales_summary",
    "A10",
    """
    SELECT strftime(l_shipdate, '%Y-%m-%d') AS stat_date, l_partkey AS product_key, l_suppkey AS store_key,
           l_returnflag AS promotion_key,
           CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total_quantity,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS total_amount,
           COUNT(*) AS txn_count
    FROM lineitem GROUP BY 1, 2, 3, 4
    """,
)
def daily_sales_summary(t):
    net = N.money("l_extendedprice") * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))
    return t.lineitem.groupBy(
        N.day_key("l_shipdate").alias("stat_date"),
        F.col("l_partkey").alias("product_key"),
        F.col("l_suppkey").alias("store_key"),
        F.col("l_returnflag").alias("promotion_key"),
    ).agg(
        N.as_double(F.sum(N.money("l_quantity"))).alias("total_quantity"),
        N.as_double(F.sum(net)).alias("total_amount"),
        F.count("*").alias("txn_count"),
    )


@query(
    "metric_statistics",
    "A4",
    """
    SELECT l_returnflag, l_linestatus, COUNT(*) AS n,
           CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
           CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS avg_qty,
           MIN(l_extendedprice) AS min_price, MAX(l_extendedprice) AS max_price
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
)
def metric_statistics(t):
    qty = F.sum(N.money("l_quantity"))
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        N.as_double(qty).alias("sum_qty"),
        N.ratio(qty, F.count("*")).alias("avg_qty"),
        F.min("l_extendedprice").alias("min_price"),
        F.max("l_extendedprice").alias("max_price"),
    )


@query(
    "table_statistics",
    "A11 A13",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, COUNT(*) AS row_count, TRUE AS sized_by_files FROM {n}"
        for n in ("customer", "part", "orders", "lineitem", "events", "documents")
    ),
)
def table_statistics(t):
    """SQL cannot tell the size of the files behind a view, only that the figures agree with each other and are no estimate."""
    parts = [A.table_statistics(getattr(t, n), n) for n in ("customer", "part", "orders", "lineitem", "events", "documents")]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    size = F.col("size_bytes")
    known = (size > 0) & (size != F.col("row_count") * A.FALLBACK_ROW_BYTES) & (F.round(F.col("avg_row_bytes") * F.col("row_count")) == size)
    return result.select("table_name", "row_count", known.alias("sized_by_files"))


@query(
    "declared_rollup",
    "A2 A3 A16",
    """
    SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS stat_date, COUNT(event_id) AS n_events,
           COUNT(DISTINCT user_id) AS n_users, MIN(value) AS min_value, MAX(value) AS max_value
    FROM events GROUP BY 1, 2
    """,
)
def declared_rollup(t):
    rules = [
        A.AggregationRule("n_events", "COUNT", "event_id", ("event_type",)),
        A.AggregationRule("n_users", "COUNT_DISTINCT", "user_id", ("event_type",)),
        A.AggregationRule("min_value", "MIN", "value", ("event_type",)),
        A.AggregationRule("max_value", "MAX", "value", ("event_type",)),
    ]
    daily = A.rollup(t.events, rules, "ts")
    return daily.withColumn("stat_date", N.day_key("stat_time")).drop("stat_time")


_DAILY_VALUE = """
    daily AS (SELECT event_type, CAST(ts AS DATE) AS d, SUM(CAST(value AS DECIMAL(18,2))) AS v, COUNT(*) AS n
              FROM events GROUP BY 1, 2)
"""


def _trailing_sql(days: int) -> str:
    return f"""
    WITH {_DAILY_VALUE}
    SELECT event_type, strftime(d, '%Y-%m-%d') AS stat_date,
           CAST(SUM(v) OVER w AS DOUBLE) AS value_{days}d, CAST(SUM(n) OVER w AS BIGINT) AS events_{days}d
    FROM daily
    WINDOW w AS (PARTITION BY event_type ORDER BY d RANGE BETWEEN INTERVAL {days - 1} DAYS PRECEDING AND CURRENT ROW)
    """


def _trailing(t, days):
    daily = t.events.groupBy("event_type", F.to_date("ts").alias("d")).agg(
        F.sum(N.money("value")).alias("value"), F.count("*").alias("events")
    )
    spans = W.trailing_days(daily, ["event_type"], "d", ["value", "events"], days)
    return spans.select(
        "event_type",
        N.day_key("d").alias("stat_date"),
        N.as_double(F.col(f"value_{days}d")).alias(f"value_{days}d"),
        F.col(f"events_{days}d"),
    )


@query("trailing_7d", "A3 W3", _trailing_sql(7))
def trailing_7d(t):
    return _trailing(t, 7)


@query("trailing_30d", "A3 W3", _trailing_sql(30))
def trailing_30d(t):
    return _trailing(t, 30)


@query(
    "top_products_per_month",
    "W4",
    """
    WITH sales AS (
      SELECT strftime(l_shipdate, '%Y-%m') AS ship_month, l_partkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS a
      FROM lineitem GROUP BY 1, 2),
    ranked AS (SELECT *, RANK() OVER (PARTITION BY ship_month ORDER BY a DESC) AS r FROM sales)
    SELECT ship_month, l_partkey AS product_id, CAST(a AS DOUBLE) AS amount, r AS rank FROM ranked WHERE r <= 3
    """,
)
def top_products_per_month(t):
    sales = t.lineitem.groupBy(N.month_key("l_shipdate").alias("ship_month"), F.col("l_partkey").alias("product_id")).agg(
        F.sum(N.money("l_extendedprice")).alias("a")
    )
    best = W.top_in_group(sales, ["ship_month"], [F.desc("a")], 3, "rank")
    return best.select("ship_month", "product_id", N.as_double(F.col("a")).alias("amount"), "rank")


@query(
    "first_last_status",
    "W5",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus,
           FIRST_VALUE(o_orderstatus) OVER w AS first_status, LAST_VALUE(o_orderstatus) OVER w AS last_status
    FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
)
def first_last_status(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    ends = W.attach_first_last(
        orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus", "first_status", "last_status"
    )
    return ends.drop("o_orderdate")


@query(
    "previous_event",
    "W5 U2",
    """
    SELECT event_id, LAG(event_type) OVER w AS previous_type, LEAD(event_id) OVER w AS next_id
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
)
def previous_event(t):
    events = t.events.select("event_id", "user_id", "ts", "event_type")
    found = W.neighbours(events, ["user_id"], ["ts", "event_id"], {"previous_type": "event_type"}, {"next_id": "event_id"})
    return found.select("event_id", "previous_type", "next_id")


@query(
    "dense_surrogate_keys",
    "W2",
    """
    SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) AS row_key FROM orders
    """,
)
def dense_surrogate_keys(t):
    orders = t.orders.select("o_orderkey", "o_orderdate")
    return W.dense_row_key(orders, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_key")


_EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query(
    "pivot_events",
    "A14",
    "SELECT user_id, "
    + ", ".join(
        f"CAST(COALESCE(SUM(CASE WHEN event_type = '{e}' THEN CAST(value AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS {e}"
        for e in _EVENT_TYPES
    )
    + " FROM events GROUP BY user_id",
)
def pivot_events(t):
    wide = A.pivot_sum(t.events, "user_id", "event_type", _EVENT_TYPES, F.sum(N.money("value")))
    return wide.select("user_id", *[N.as_double(F.col(e)).alias(e) for e in _EVENT_TYPES])


@query(
    "unpivot_charges",
    "A15",
    """
    SELECT l_returnflag, 'discount' AS charge, CAST(SUM(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM lineitem GROUP BY 1
    UNION ALL
    SELECT l_returnflag, 'tax', CAST(SUM(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) FROM lineitem GROUP BY 1
    """,
)
def unpivot_charges(t):
    lines = t.lineitem.groupBy("l_returnflag").agg(
        N.as_double(F.sum(N.money("l_discount"))).alias("discount"), N.as_double(F.sum(N.money("l_tax"))).alias("tax")
    )
    return A.unpivot(lines, ["l_returnflag"], ["discount", "tax"], "charge", "amount")


@query(
    "statuses_in_order",
    "A17",
    """
    WITH u AS (SELECT o_custkey, o_orderpriority AS p, MIN(o_orderdate) AS d FROM orders GROUP BY 1, 2)
    SELECT o_custkey, STRING_AGG(p, ',' ORDER BY d, p) AS priorities FROM u GROUP BY o_custkey
    """,
)
def statuses_in_order(t):
    return A.distinct_list(t.orders, ["o_custkey"], "o_orderpriority", F.col("o_orderdate"), "priorities")


@query(
    "column_profile",
    "A12",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count, "
        f"COUNT(DISTINCT {c}) AS distinct_count, {lo} AS min_value, {hi} AS max_value, "
        f"(COUNT(*) - COUNT({c}))::DOUBLE / COUNT(*) AS null_ratio FROM lineitem"
        for c, lo, hi in [
            (c, f"CAST(MIN({c}) AS VARCHAR)", f"CAST(MAX({c}) AS VARCHAR)")
            for c in (
                "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
            )
        ]
        + [("l_shipdate", "strftime(MIN(l_shipdate), '%Y-%m-%d %H:%M:%S')", "strftime(MAX(l_shipdate), '%Y-%m-%d %H:%M:%S')")]
    ),
)
def column_profile(t):
    return A.profile_columns(t.lineitem)


@query(
    "dimension_enrichment",
    "J3 J6 P14",
    """
    SELECT o.o_orderkey, c.c_mktsegment AS segment, n.n_name AS nation,
           CASE WHEN c.c_acctbal IS NULL THEN 'unknown' WHEN c.c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS standing
    FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON c.c_custkey = o.o_custkey
    LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
    """,
)
def dimension_enrichment(t):
    known = t.customer.where("c_mktsegment <> 'BUILDING'")
    attributes = {"segment": "c_mktsegment", "_nation": "c_nationkey", "_balance": "c_acctbal"}
    placed = J.enrich(t.orders.select("o_orderkey", "o_custkey"), known, {"o_custkey": "c_custkey"}, attributes)
    named = J.enrich(placed, t.nation, {"_nation": "n_nationkey"}, {"nation": "n_name"})
    standing = (
        F.when(F.col("_balance").isNull(), "unknown").when(F.col("_balance") < 0, "debt").otherwise("credit")
    )
    return named.select("o_orderkey", "segment", "nation", standing.alias("standing"))


@query(
    "orphan_foreign_keys",
    "J4",
    """
    SELECT o_custkey, COUNT(*) AS n_rows FROM orders o
    WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal >= 0)
    GROUP BY o_custkey
    """,
)
def orphan_foreign_keys(t):
    return J.orphan_keys(t.orders, "o_custkey", t.customer.where("c_acctbal >= 0"), "c_custkey")


@query(
    "customers_without_orders",
    "J5 P15",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)
    """,
)
def customers_without_orders(t):
    pending = t.orders.where("o_orderstatus = 'P'")
    return J.not_in(t.customer, pending, {"c_custkey": "o_custkey"}).select("c_custkey", "c_name")


@query(
    "predicate_mix",
    "P15 J5 F9",
    """
    SELECT l_linestatus, COUNT(*) AS n FROM lineitem l
    WHERE (l_returnflag IN ('A', 'R') OR l_tax >= 0.05)
      AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '2000-01-01'
      AND EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_name LIKE '%ring%' AND p.p_type NOT IN ('PROMO'))
    GROUP BY l_linestatus
    """,
)
def predicate_mix(t):
    rings = t.part.where(F.col("p_name").like("%ring%") & ~F.col("p_type").isin("PROMO"))
    lines = t.lineitem.where(F.col("l_returnflag").isin("A", "R") | (F.col("l_tax") >= 0.05)).where(
        N.month_range(F.col("l_shipdate"), "1996-01-01", 48)
    )
    return J.is_in(lines, rings, {"l_partkey": "p_partkey"}).groupBy("l_linestatus").agg(F.count("*").alias("n"))


@query(
    "ordered_preview",
    "T1 T2",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
)
def ordered_preview(t):
    from lakestrata.sources.extract import preview

    ranked = t.orders.select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return preview(ranked, 100)


@query(
    "row_overlap",
    "U3 G4",
    """
    WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'),
         b AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_totalprice >= 100000),
         s AS (SELECT COUNT(*) AS n FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b))
    SELECT (SELECT COUNT(*) FROM a) AS rows_a, (SELECT COUNT(*) FROM b) AS rows_b, n AS rows_shared,
           n::DOUBLE / LEAST((SELECT COUNT(*) FROM a), (SELECT COUNT(*) FROM b)) AS overlap FROM s
    """,
)
def row_overlap(t):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus"]
    a = t.orders.where("o_orderstatus <> 'F'").select(*columns)
    b = t.orders.where("o_totalprice >= 100000").select(*columns, "o_totalprice")
    return A.row_overlap(a, b)


@query(
    "distinct_pairs",
    "U4",
    "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem",
)
def distinct_pairs(t):
    return J.distinct_rows(t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus"))


@query(
    "union_of_parties",
    "U2",
    """
    SELECT 'customer' AS party, c_custkey AS id, c_nationkey AS nation FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier
    """,
)
def union_of_parties(t):
    buyers = t.customer.select(F.lit("customer").alias("party"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    sellers = t.supplier.select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("party"), F.col("s_suppkey").alias("id"))
    return buyers.unionByName(sellers)


@query(
    "event_properties",
    "F7 F8",
    """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
           'v_' || json_extract_string(props, '$.k') AS tag FROM events
    """,
)
def event_properties(t):
    parsed = F.from_json("props", "map<string,string>")
    k = F.element_at(parsed, "k")
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.concat(F.lit("v_"), k).alias("tag"))


@query(
    "snake_case_names",
    "P1 F3",
    """
    SELECT p_partkey, trim(lower(regexp_replace(regexp_replace(trim(p_name || ' ' || p_brand || 'Type' || p_type),
             '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^a-zA-Z0-9]+', '_', 'g')), '_') AS name
    FROM part
    """,
)
def snake_case_names(t):
    raw = F.concat("p_name", F.lit(" "), "p_brand", F.lit("Type"), "p_type")
    return t.part.select("p_partkey", X.snake_case(raw).alias("name"))


@query(
    "domain_tags",
    "P11",
    "WITH x AS (SELECT doc_id, lower(source || '_' || text) AS s FROM documents) SELECT doc_id, CASE "
    + " ".join(f"WHEN contains(s, '{k}') THEN '{v}'" for k, v in X.DOMAIN_KEYWORDS.items())
    + " ELSE 'common' END AS domain FROM x",
)
def domain_tags(t):
    return t.documents.select("doc_id", X.domain_of(F.concat("source", F.lit("_"), "text")).alias("domain"))


@query(
    "layer_tags",
    "P12",
    """
    WITH x AS (SELECT p_partkey, lower(left(p_type, 3)) || '_' || p_name AS table_name FROM part
               UNION ALL SELECT p_partkey, CASE WHEN p_size < 10 THEN 'ods_' WHEN p_size < 20 THEN 'dwd_'
                 WHEN p_size < 30 THEN 'dws_' WHEN p_size < 40 THEN 'ads_' ELSE 'dim_' END || p_name FROM part)
    SELECT p_partkey, table_name, CASE WHEN starts_with(table_name, 'ods_') THEN 'ODS' WHEN starts_with(table_name, 'dwd_') THEN 'DWD'
      WHEN starts_with(table_name, 'dws_') THEN 'DWS' WHEN starts_with(table_name, 'ads_') THEN 'ADS'
      WHEN starts_with(table_name, 'dim_') THEN 'DIM' WHEN starts_with(table_name, 'tmp_') THEN 'TMP' END AS layer FROM x
    """,
)
def layer_tags(t):
    plain = F.concat(F.lower(F.substring("p_type", 1, 3)), F.lit("_"), "p_name")
    size = F.col("p_size")
    prefix = (
        F.when(size < 10, "ods_").when(size < 20, "dwd_").when(size < 30, "dws_").when(size < 40, "ads_").otherwise("dim_")
    )
    names = F.explode(F.array(plain, F.concat(prefix, "p_name"))).alias("table_name")
    return t.part.select("p_partkey", names).withColumn("layer", X.layer_of(F.col("table_name")))
