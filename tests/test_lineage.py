from pyspark.sql import functions as F

from lakestrata.operators import lineage as L
from tests.conftest import rows

EDGES = "src string, dst string"
COLUMN_EDGES = "src_table string, src_column string, dst_table string, dst_column string, transform string"


def edges(spark, text):
    return spark.createDataFrame([tuple(e.split(">")) for e in text.split()], EDGES)


def test_edges_from_statements(spark):
    log = [
        "INSERT INTO dwd_a SELECT * FROM ods_a",
        "insert overwrite table `dws_b` select * from (select * from dwd_a) t join dim_x on 1=1",
        "CREATE TABLE IF NOT EXISTS ads_c AS SELECT 1 FROM dws_b, other",
        "MERGE INTO dim_x USING s ON 1=1; SELECT 1 FROM feed;",
        "WITH a AS (SELECT * FROM raw1), b AS (SELECT * FROM a) INSERT INTO out SELECT * FROM b JOIN raw2 ON 1=1",
        "INSERT INTO self SELECT * FROM self JOIN dual ON 1=1",
        "SELECT * FROM nothing_written",
        "INSERT INTO t2 SELECT * FROM (SELECT x FROM inner_t)",
    ]
    df = spark.createDataFrame(list(enumerate(log)), "stmt_id int, sql string")
    assert rows(L.edges_from_log(df)) == sorted(
        [
            ("ods_a", "dwd_a", "INSERT INTO"),
            ("dwd_a", "dws_b", "INSERT INTO"),
            ("dim_x", "dws_b", "INSERT INTO"),
            ("dws_b", "ads_c", "CTAS"),
            ("other", "ads_c", "CTAS"),
            ("feed", "dim_x", "MERGE"),
            ("raw1", "out", "INSERT INTO"),
            ("raw2", "out", "INSERT INTO"),
            ("inner_t", "t2", "INSERT INTO"),
        ],
        key=repr,
    )


AWKWARD_LOG = [
    "WITH a AS (SELECT * FROM u),b AS (SELECT * FROM a) INSERT INTO o SELECT a.x, b.y AS yy FROM a, b, z",
    "INSERT INTO dws.d (k, total) SELECT o.user_id, sum(o.amt * l.qty) FROM dwd.orders o JOIN `dwd`.`lines` AS l ON o.id = l.id, dim c WHERE o.x IN (SELECT q FROM w)",
    "CREATE TABLE ads_x AS SELECT DISTINCT t.a, CASE WHEN t.b > 1 THEN c ELSE 'x, y FROM no' END AS flag, cast(t.d AS decimal(10, 2)) AS d2, count(*) AS n, upper(name) nm, * "
    "FROM (SELECT a, b FROM deep) t /* , no n */ UNION SELECT q FROM other",
    "INSERT OVERWRITE TABLE r SELECT extract(year FROM ts) AS y, row_number() OVER (PARTITION BY u ORDER BY ts) AS rn, e.addr.city, ev.a IS NOT DISTINCT FROM e.b AS eq FROM ev e",
    "SELECT a FROM b",
    None,
    "",
    "MERGE INTO m USING (SELECT x FROM src) s ON m.id = s.id",
    "INSERT INTO self SELECT s.a FROM self s",
    "INSERT INTO lonely SELECT 1 AS one, 'x' AS two",
]


def test_awkward_statements(spark):
    df = spark.createDataFrame([*enumerate(AWKWARD_LOG), (99, AWKWARD_LOG[0])], "stmt_id int, sql string")
    assert rows(L.edges_from_log(df).select("src", "dst")) == sorted([
        ("u", "o"), ("z", "o"), ("dwd.orders", "dws.d"), ("dwd.lines", "dws.d"), ("dim", "dws.d"), ("w", "dws.d"), ("deep", "ads_x"), ("other", "ads_x"), ("ev", "r"), ("src", "m"),
    ], key=repr)
    assert rows(L.column_edges_from_log(df)) == sorted([
        ("u", "x", "o", "x", "direct"), ("u", "y", "o", "yy", "direct"), ("dwd.orders", "user_id", "dws.d", "k", "direct"), ("dwd.orders", "amt", "dws.d", "total", "SUM()"),
        ("dwd.lines", "qty", "dws.d", "total", "SUM()"), ("deep", "a", "ads_x", "a", "direct"), ("deep", "b", "ads_x", "flag", "CASE"), ("deep", "c", "ads_x", "flag", "CASE"),
        ("deep", "d", "ads_x", "d2", "CAST()"), ("deep", "name", "ads_x", "nm", "UPPER()"), ("ev", "u", "r", "rn", "ROW_NUMBER()"), ("ev", "ts", "r", "rn", "ROW_NUMBER()"),
        ("ev", "addr", "r", "city", "direct"), ("ev", "a", "r", "eq", "expression"), ("ev", "b", "r", "eq", "expression"),
    ], key=repr)
    empty = spark.createDataFrame([], "stmt_id int, sql string")
    assert L.edges_from_log(empty).collect() == [] and L.column_edges_from_log(empty).collect() == []


def test_trace_takes_the_least_depth_and_smallest_path(spark):
    g = edges(spark, "a>b a>c b>d c>d d>e a>e e>a x>a")
    got = rows(L.trace(g, "a"))
    assert got == [("b", 1, ["a", "b"]), ("c", 1, ["a", "c"]), ("d", 2, ["a", "b", "d"]), ("e", 1, ["a", "e"])]
    assert [r["node"] for r in L.trace(g, "d", "upstream").orderBy("depth", "node").collect()] == ["b", "c", "a", "e", "x"]
    assert rows(L.trace(g, "a", max_depth=1).select("node")) == [("b",), ("c",), ("e",)]
    assert L.trace(g, "unknown").collect() == []


def test_hub_with_very_many_edges(spark):
    g = edges(spark, "a>hub").union(spark.range(3000).select(F.lit("hub"), F.concat(F.lit("n"), F.col("id"))))
    assert L.trace(g, "a").groupBy("depth").count().orderBy("depth").collect()[1]["count"] == 3000


def test_several_origins_in_one_run_and_one_store(spark):
    g = edges(spark, "a>b b>c x>c c>d d>a a>b").union(edges(spark, "n>n"))
    store = L.store_edges(g)
    assert store.rows.count() == 6
    found = L.trace_many(store, ["a", "x", "n", "none", "a"])
    assert rows(found.select("origin", "node", "depth")) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("x", "a", 3), ("x", "b", 4), ("x", "c", 1), ("x", "d", 2)]
    assert L.trace_many(store, []).collect() == [] and L.trace(edges(spark, "a>b").limit(0), "a").collect() == []
    null = spark.createDataFrame([("a", None), (None, "b"), ("a", "b")], EDGES)
    assert rows(L.trace(null, "a").select("node")) == [("b",)]


def test_a_hop_reads_the_buckets_of_its_frontier_only(spark):
    g = edges(spark, " ".join(f"n{i}>n{i + 1}" for i in range(300)))
    store = L.store_edges(g, buckets=16)
    one = store.beside([3])
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert 0 < one.count() < 300
    asked = []

    class Watched(L.EdgeStore):
        def beside(self, buckets):
            asked.append(len(buckets))
            return super().beside(buckets)

    assert L.trace(Watched(*store), "n0", max_depth=5).count() == 5
    assert asked == [1] * 5  # of 16


def test_column_trace_switches_to_tables_after_one_hop(spark):
    tables = edges(spark, "raw>dwd raw>dim dwd>dws dim>dws2")
    cols = spark.createDataFrame([("raw", "user_id", "dwd", "user_id", "direct"), ("dwd", "user_id", "dws", "dau", "COUNT()")], COLUMN_EDGES)
    assert rows(L.trace_from_column(cols, tables, "raw", "user_id").select("node", "depth")) == [("dwd", 1), ("dws", 2)]
    assert rows(L.trace_columns(cols, "raw", "user_id").select("node")) == [("dwd.user_id",), ("dws.dau",)]
    assert rows(L.trace_columns(cols, "dws", "dau", "upstream").select("node")) == [("dwd.user_id",), ("raw.user_id",)]


def test_impact(spark):
    tables = edges(spark, "raw>dwd dwd>dws dwd>ads")
    cols = spark.createDataFrame([("raw", "user_id", "dwd", "user_id", "direct")], COLUMN_EDGES)
    assert L.impact(tables, cols, "raw").first().asDict() == {
        "source_table": "raw", "total_affected": 3, "impact_depth": 2, "direct": 1, "indirect": 2, "affected_columns": 1,
    }
    assert L.impact(tables, cols, "ads").first()["total_affected"] == 0
    assert rows(L.affected_columns(cols, "raw")) == [("user_id", "dwd", "user_id", "direct")]


def test_cycles(spark):
    g = edges(spark, "a>b b>c c>a b>a s>s x>a c>y y>z")
    got = {tuple(r["path"]) for r in L.cycles(g, 5).collect()}
    assert got == {("a", "b", "a"), ("a", "b", "c", "a"), ("s", "s")}
    assert {tuple(r["path"]) for r in L.cycles(g, 2).collect()} == {("a", "b", "a"), ("s", "s")}
    assert L.cycles(edges(spark, "a>b b>c"), 5).collect() == []
    assert {tuple(r["path"]) for r in L.cycles(g, components=L.cycle_components(g)).collect()} == got


def test_nodes_on_cycles(spark):
    g = edges(spark, "a>b b>c c>a b>a s>s x>a c>y y>z z>w w>z")
    assert rows(L.cycle_components(g)) == [("a", "a"), ("b", "a"), ("c", "a"), ("s", "s"), ("w", "w"), ("z", "w")]
    assert L.cycle_components(edges(spark, "a>b b>c a>c")).collect() == [] and L.cycle_components(g.limit(0)).collect() == []
    null = spark.createDataFrame([("a", None), (None, "a"), (None, None), ("q", "q")], EDGES)
    assert rows(L.cycle_components(null)) == [("q", "q")]
    # 40 nodes that all feed each other have more simple cycles than there are atoms; a tail hangs on both sides.
    dense = " ".join(f"k{i:02}>k{j:02}" for i in range(40) for j in range(40) if i != j)
    found = rows(L.cycle_components(edges(spark, f"{dense} t0>t1 t1>k00 k39>u0 u0>u1")))
    assert found == [(f"k{i:02}", "k00") for i in range(40)]


def test_components_against_brute_force(spark):
    import random

    for seed in range(3):
        rng = random.Random(seed)
        pairs = {(str(rng.randrange(30)), str(rng.randrange(30))) for _ in range(45)}
        reach = {n: {b for a, b in pairs if a == n} for n in map(str, range(30))}
        for _ in range(30):
            reach = {n: r.union(*(reach[m] for m in r)) for n, r in reach.items()}
        want = [(n, min(m for m in r if n in reach[m])) for n, r in reach.items() if n in r]
        assert rows(L.cycle_components(spark.createDataFrame(sorted(pairs), EDGES))) == sorted(want, key=repr)


def test_roots(spark):
    assert rows(L.roots(edges(spark, "a>b b>c d>c"))) == [("a",), ("d",)]
    assert rows(L.roots(edges(spark, "a>b b>a"))) == [("a",), ("b",)]


def test_flow_problems(spark):
    flow = edges(spark, "ods_o>dwd_o dwd_o>ads_r ods_o>ads_r nolayer>dwd_o dwd_o>homeless dim_d>dwd_o")
    layers = spark.createDataFrame([("ods_o", "ODS"), ("dwd_o", "DWD"), ("ads_r", "ADS"), ("dim_d", "DIM")], "table_name string, layer string")
    assert rows(L.flow_problems(flow, layers)) == sorted(
        [
            ("ads_r", "ods_o", "forbidden_transition"),
            ("dwd_o", "nolayer", "upstream_without_layer"),
            ("dwd_o", "dim_d", "forbidden_transition"),
            ("homeless", "", "table_without_layer"),
        ],
        key=repr,
    )
    relaxed = L.flow_problems(flow, layers, [*L.ALLOWED_TRANSITIONS, ("DIM", "DWD")])
    assert ("dwd_o", "dim_d", "forbidden_transition") not in rows(relaxed)


def test_edge_store_keeps_the_last_transformation(spark):
    kind = COLUMN_EDGES + ", seq int"
    old = spark.createDataFrame([("a", "x", "b", "y", "direct", 1), ("a", "z", "b", "z", "direct", 1)], kind)
    new = spark.createDataFrame([("a", "x", "b", "y", "SUM()", 2), ("a", "x", "b", "y", "AVG()", 3)], kind)
    assert rows(L.upsert_edges(old, new, "seq").select("src_column", "transform")) == [("x", "AVG()"), ("z", "direct")]
