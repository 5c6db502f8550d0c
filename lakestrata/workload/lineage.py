"""Lineage over graphs that the tables contain."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakestrata.operators import lineage as L
from lakestrata.operators import windows as W
from lakestrata.session import deal
from lakestrata.workload import query

# The supply graph: region -> nation -> customer -> order -> part -> supplier.
_GRAPH = """
    edges AS (SELECT DISTINCT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation
        UNION SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
        UNION SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders
        UNION SELECT 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem
        UNION SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey FROM lineitem)
"""


def _node(kind, column):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def supply_edges(t):
    hops = [
        (t.nation, "region", "n_regionkey", "nation", "n_nationkey"),
        (t.customer, "nation", "c_nationkey", "customer", "c_custkey"),
        (t.orders, "customer", "o_custkey", "order", "o_orderkey"),
        (t.lineitem, "order", "l_orderkey", "part", "l_partkey"),
        (t.lineitem, "part", "l_partkey", "supplier", "l_suppkey"),
    ]
    parts = [df.select(_node(a, x).alias("src"), _node(b, y).alias("dst")) for df, a, x, b, y in hops]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _reach(start: str, near: str, far: str, hops: int, first: str | None = None, path: bool = True) -> str:
    """Breadth-first levels; each node of the supply graph has one distance from a start."""
    levels = [f"l0 AS (SELECT '{start}' AS node, ['{start}'] AS path)"]
    for d in range(1, hops + 1):
        source = first if first and d == 1 else "edges"
        levels.append(
            f"l{d} AS (SELECT e.{far} AS node, MIN(list_append(l.path, e.{far})) AS path FROM l{d - 1} l "
            f"JOIN {source} e ON e.{near} = l.node GROUP BY e.{far})"
        )
    rows = " UNION ALL ".join(f"SELECT node, {d} AS depth, path FROM l{d}" for d in range(1, hops + 1))
    return f"WITH {_GRAPH}, {', '.join(levels)}, reached AS ({rows})"


def _printed(df):
    return df.select("node", F.col("depth").cast("long").alias("depth"), F.array_join("path", ">").alias("path"))


@query(
    "trace_downstream",
    "N3",
    _reach("nation:7", "src", "dst", 4)
    + " SELECT node, CAST(depth AS BIGINT) AS depth, array_to_string(path, '>') AS path FROM reached",
)
def trace_downstream(t):
    return _printed(L.trace(supply_edges(t), "nation:7", "downstream"))


@query(
    "trace_upstream",
    "N3",
    _reach("supplier:3", "dst", "src", 5)
    + " SELECT node, CAST(depth AS BIGINT) AS depth, array_to_string(path, '>') AS path FROM reached",
)
def trace_upstream(t):
    return _printed(L.trace(supply_edges(t), "supplier:3", "upstream"))


@query(
    "direct_neighbours",
    "N2",
    f"""
    WITH {_GRAPH} SELECT 'up' AS side, src AS node FROM edges WHERE dst = 'part:5'
    UNION ALL SELECT 'down', dst FROM edges WHERE src = 'part:5'
    """,
)
def direct_neighbours(t):
    edges = supply_edges(t)
    up = L.upstream(edges, "part:5").select(F.lit("up").alias("side"), "node")
    return up.unionByName(L.downstream(edges, "part:5").select(F.lit("down").alias("side"), "node"))


@query(
    "lineage_roots",
    "N9",
    f"WITH {_GRAPH} SELECT DISTINCT src AS node FROM edges WHERE src NOT IN (SELECT dst FROM edges)",
)
def lineage_roots(t):
    return L.roots(supply_edges(t))


def _column_edges(t):
    """Columns of orders, with the status as the transformation, and of the parts in them."""
    orders = t.orders.select(
        _node("customer", "o_custkey").alias("src_table"),
        F.lit("c_custkey").alias("src_column"),
        _node("order", "o_orderkey").alias("dst_table"),
        F.lit("o_custkey").alias("dst_column"),
        F.col("o_orderstatus").alias("transform"),
    )
    # Keys are fewer bytes than names, so they are made different first.
    lines = deal(t.lineitem.select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey").distinct().select(
        _node("order", "l_orderkey").alias("src_table"), F.lit("o_custkey").alias("src_column"),
        _node("part", "l_partkey").alias("dst_table"), F.lit("buyer").alias("dst_column"), F.lit("COUNT()").alias("transform"),
    )
    return orders.unionByName(lines)


@query(
    "trace_from_column",
    "N4",
    _reach("customer:7", "src", "dst", 3) + " SELECT node, CAST(depth AS BIGINT) AS depth, array_to_string(path, '>') AS path FROM reached",
)
def trace_from_column(t):
    return _printed(L.trace_from_column(_column_edges(t), supply_edges(t), "customer:7", "c_custkey"))


@query(
    "trace_columns",
    "N4",
    """
    WITH a AS (SELECT 'order:' || o_orderkey || '.o_custkey' AS node FROM orders WHERE o_custkey = 7),
         b AS (SELECT DISTINCT 'part:' || l_partkey || '.buyer' AS node FROM lineitem
               WHERE 'order:' || l_orderkey || '.o_custkey' IN (SELECT node FROM a))
    SELECT node, 1 AS depth FROM a UNION ALL SELECT node, 2 FROM b
    """,
)
def trace_columns(t):
    return L.trace_columns(_column_edges(t), "customer:7", "c_custkey").select("node", "depth")


@query(
    "impact_summary",
    "N6 N10",
    _reach("customer:7", "src", "dst", 3)
    + """
    SELECT 'customer:7' AS source_table, COUNT(*) AS total_affected, CAST(MAX(depth) AS BIGINT) AS impact_depth,
           CAST(COUNT_IF(depth = 1) AS BIGINT) AS direct, CAST(COUNT_IF(depth > 1) AS BIGINT) AS indirect,
           (SELECT COUNT(*) FROM orders WHERE o_custkey = 7) AS affected_columns FROM reached
    """,
)
def impact_summary(t):
    return L.impact(supply_edges(t), _column_edges(t), "customer:7")


@query(
    "direct_and_indirect",
    "N10",
    _reach("order:42", "src", "dst", 2)
    + " SELECT node, CASE WHEN depth = 1 THEN 'direct' ELSE 'indirect' END AS reach FROM reached",
)
def direct_and_indirect(t):
    return L.by_reach(L.trace(supply_edges(t), "order:42")).select("node", "reach")


def _transitions(t):
    """Consecutive event types of each user, with the step's property as its transformation."""
    events = t.events.select("event_id", "user_id", "ts", "event_type", "props")
    ordered = W.next_row(events, ["user_id"], ["ts", "event_id"], {"next_type": "event_type"})
    steps = ordered.where("next_type IS NOT NULL")
    return steps.select(
        F.concat(F.lit("state."), "event_type").alias("src"), F.concat(F.lit("state."), "next_type").alias("dst"), F.col("props").alias("transform"), "event_id", "ts"
    )


_STEPS = """
    steps AS (SELECT 'state.' || event_type AS src, 'state.' || LEAD(event_type) OVER w AS dst, props AS transform, event_id, ts
              FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    moves AS (SELECT * FROM steps WHERE dst IS NOT NULL)
"""


@query(
    "lineage_cycles",
    "N5",
    f"""
    WITH RECURSIVE {_STEPS},
    e AS (SELECT DISTINCT src, dst FROM moves),
    walk AS (SELECT [src, dst] AS path, src AS first, dst AS last, 1 AS n FROM e WHERE dst >= src
             UNION ALL
             SELECT list_append(path, e.dst), first, e.dst, n + 1 FROM walk JOIN e ON e.src = walk.last
             WHERE walk.last <> walk.first AND e.src <> e.dst AND e.dst >= first
               AND (e.dst = first OR NOT list_contains(path, e.dst)))
    SELECT array_to_string(path, ' -> ') AS cycle, CAST(n AS BIGINT) AS length FROM walk WHERE last = first
    """,
)
def lineage_cycles(t):
    found = L.cycles(_transitions(t))
    return found.select(F.array_join("path", " -> ").alias("cycle"), F.col("length").cast("long").alias("length"))


@query(
    "nodes_on_cycles",
    "N5",
    """
    WITH RECURSIVE e AS (SELECT DISTINCT 'item:' || l_partkey AS src, 'item:' || l_suppkey AS dst FROM lineitem),
    core AS (SELECT * FROM e WHERE src IN (SELECT dst FROM e)),
    reach AS (SELECT src, dst FROM core UNION SELECT r.src, c.dst FROM reach r JOIN core c ON c.src = r.dst)
    SELECT a.src AS node, MIN(b.src) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src
    """,
)
def nodes_on_cycles(t):
    edges = t.lineitem.select(_node("item", "l_partkey").alias("src"), _node("item", "l_suppkey").alias("dst"))
    return L.cycle_components(edges)


@query(
    "stored_edges",
    "N7",
    f"""
    WITH {_STEPS},
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY src, dst ORDER BY event_id DESC) AS rn FROM moves)
    SELECT src, dst, transform, event_id FROM r WHERE rn = 1
    """,
)
def stored_edges(t):
    moves = _transitions(t)
    half = F.to_timestamp_ntz(F.lit("2024-01-15"))
    columns = ["src", "dst", "transform", "event_id"]
    early, late = moves.where(F.col("ts") < half).select(*columns), moves.where(F.col("ts") >= half).select(*columns)
    empty = early.where(F.lit(False))
    return L.upsert_edges(L.upsert_edges(empty, early, "event_id"), late, "event_id")


_FLOW_TABLES = """
    named AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN 'ods_' WHEN p_size < 20 THEN 'dwd_' WHEN p_size < 30 THEN 'dws_'
                WHEN p_size < 40 THEN 'ads_' WHEN p_size < 45 THEN 'Dim_' ELSE 'tmp_' END || replace(p_name, ' ', '_') || '_' || p_partkey AS table_name,
                CASE p_type WHEN 'ECONOMY' THEN 'ODS' WHEN 'STANDARD' THEN 'DWD' WHEN 'PROMO' THEN 'DWS' WHEN 'SMALL' THEN 'ADS' WHEN 'LARGE' THEN 'DIM' END AS layer,
                p_brand FROM part),
    layers AS (SELECT table_name, layer FROM named WHERE layer IS NOT NULL)
"""
_PATTERNS = {"ODS": "^ods_[a-z][a-z0-9_]*$", "DWD": "^dwd_[a-z][a-z0-9_]*$", "DWS": "^dws_[a-z][a-z0-9_]*(_[0-9]+[hdwmy])?$",
             "ADS": "^ads_[a-z][a-z0-9_]*$", "DIM": "^dim_[a-z][a-z0-9_]*$", "TMP": "^tmp_[a-z][a-z0-9_]*$"}


def _placement_sql(source: str) -> str:
    prefix = " ".join(f"WHEN '{k}' THEN '{k.lower()}_'" for k in _PATTERNS)
    pattern = " ".join(f"WHEN '{k}' THEN regexp_matches(table_name, '{v}')" for k, v in _PATTERNS.items())
    foreign = " ".join(f"WHEN layer <> '{k}' AND starts_with(table_name, '{k.lower()}_') THEN '{k.lower()}_'" for k in _PATTERNS)
    return f"""
    c AS (SELECT table_name, layer, CASE layer {prefix} END AS prefix, CASE layer {pattern} END AS fits, CASE {foreign} END AS other FROM {source}),
    placed AS (SELECT table_name, layer, 'placement.prefix' AS rule, prefix AS detail FROM c WHERE NOT starts_with(table_name, prefix)
      UNION ALL SELECT table_name, layer, 'placement.pattern', layer FROM c WHERE NOT fits
      UNION ALL SELECT table_name, layer, 'placement.foreign_prefix', other FROM c WHERE other IS NOT NULL)
    """


def _flow_tables(t):
    size, kind = F.col("p_size"), F.col("p_type")
    prefix = (
        F.when(size < 10, "ods_").when(size < 20, "dwd_").when(size < 30, "dws_").when(size < 40, "ads_").when(size < 45, "Dim_").otherwise("tmp_")
    )
    name = F.concat(prefix, F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"))
    layers = {"ECONOMY": "ODS", "STANDARD": "DWD", "PROMO": "DWS", "SMALL": "ADS", "LARGE": "DIM"}
    layer = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in layers.items()])
    return t.part.select("p_partkey", name.alias("table_name"), layer.alias("layer"), "p_brand")


@query(
    "layer_placement",
    "C15",
    f"WITH {_FLOW_TABLES}, {_placement_sql('layers')} SELECT * FROM placed",
)
def layer_placement(t):
    from lakestrata.operators.audit import placement_problems

    return placement_problems(_flow_tables(t).where("layer IS NOT NULL").select("table_name", "layer"))


@query(
    "flow_compliance",
    "N8 J9 P12",
    f"""
    WITH {_FLOW_TABLES},
    flow AS (SELECT DISTINCT a.table_name AS src, b.table_name AS dst FROM lineitem
             JOIN named a ON a.p_partkey = l_partkey JOIN named b ON b.p_partkey = l_suppkey),
    j AS (SELECT src, dst, s.layer AS sl, d.layer AS dl FROM flow LEFT JOIN layers s ON s.table_name = src LEFT JOIN layers d ON d.table_name = dst),
    targets AS (SELECT DISTINCT dst AS table_name, dl AS layer FROM j WHERE dl IS NOT NULL),
    {_placement_sql('targets')}
    SELECT dst AS table_name, src AS upstream, CASE WHEN sl IS NULL THEN 'upstream_without_layer' ELSE 'forbidden_transition' END AS problem
    FROM j WHERE dl IS NOT NULL AND (sl IS NULL OR (sl || dl) NOT IN ('ODSDWD', 'DWDDWS', 'DWSADS', 'DWDADS', 'DWDDIM', 'ODSTMP', 'DWDTMP'))
    UNION ALL SELECT DISTINCT dst, '', 'table_without_layer' FROM j WHERE dl IS NULL
    UNION ALL SELECT table_name, '', rule FROM placed
    """,
)
def flow_compliance(t):
    tables = _flow_tables(t)
    a = tables.select(F.col("p_partkey").alias("l_partkey"), F.col("table_name").alias("src"))
    b = tables.select(F.col("p_partkey").alias("l_suppkey"), F.col("table_name").alias("dst"))
    pairs = deal(t.lineitem.select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey").distinct()
    edges = pairs.join(a, "l_partkey").join(b, "l_suppkey").select("src", "dst")
    return L.flow_problems(edges, tables.where("layer IS NOT NULL").select("table_name", "layer"))
