"""Jobs over a statement log; the log is written out from the events, one statement each."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakestrata.operators import lineage as L
from lakestrata.operators import querylog as Q
from lakestrata.workload import query

_TEMPLATES = {
    "click": "SELECT user_id, count(*) FROM ods_events_# GROUP BY user_id ORDER BY 2 DESC",
    "view": "INSERT INTO dwd_views_# SELECT * FROM ods_events_# e JOIN dim_user u ON e.user_id = u.id WHERE e.value > 3 OR u.name LIKE '%a%'",
    "purchase": "WITH x AS (SELECT DISTINCT user_id FROM ods_events_#), y AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) rn FROM x) "
    "INSERT OVERWRITE TABLE `dws_purchase_#` SELECT y.user_id, sum(v) FROM y JOIN dim_a ON 1 = 1 JOIN dim_b ON 1 = 1 JOIN dim_c ON 1 = 1 "
    "JOIN dim_d ON 1 = 1 LEFT JOIN dim_e ON 1 = 1 WHERE y.user_id NOT IN (SELECT user_id FROM dwd_views_#) GROUP BY y.user_id ORDER BY 1;",
    "signup": "CREATE TABLE IF NOT EXISTS ads_signup_# AS SELECT CASE WHEN EXISTS (SELECT 1 FROM dws_purchase_#) THEN 1 ELSE 0 END f FROM dual UNION SELECT 2 FROM (SELECT 3 FROM dws_purchase_#) z",
    "error": "MERGE INTO dim_user USING (SELECT * FROM ods_events_#) s ON dim_user.id = s.user_id; DROP TABLE tmp_#",
}
_LOG = "log AS (SELECT event_id AS stmt_id, replace(CASE event_type " + " ".join(
    "WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in _TEMPLATES.items()
) + " END, '#', CAST(user_id AS VARCHAR)) AS sql FROM events)"


def statement_log(t):
    text = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in _TEMPLATES.items()])
    return t.events.select(F.col("event_id").alias("stmt_id"), F.replace(text, F.lit("#"), F.col("user_id").cast("string")).alias("sql"))


_OPERATION_SQL = """list_filter([
    CASE WHEN contains(u, 'GROUP BY') THEN 'aggregation' END, CASE WHEN contains(u, 'ORDER BY') THEN 'sorting' END,
    CASE WHEN contains(u, 'DISTINCT') THEN 'deduplication' END, CASE WHEN j > 0 THEN 'join' END, CASE WHEN s > 0 THEN 'subquery' END,
    CASE WHEN w THEN 'window_function' END, CASE WHEN c THEN 'cte' END, CASE WHEN contains(u, 'UNION') THEN 'union' END,
    CASE WHEN regexp_matches(u, '\\bLIKE\\b') THEN 'pattern_match' END, CASE WHEN contains(u, 'EXISTS') THEN 'existence_check' END,
    CASE WHEN contains(u, 'CASE') THEN 'conditional_logic' END], lambda x: x IS NOT NULL)"""

_FEATURES = f"""
    {_LOG},
    f AS (SELECT stmt_id, sql, upper(sql) AS u, len(regexp_extract_all(upper(sql), '\\bJOIN\\b')) AS j,
            len(regexp_extract_all(upper(sql), 'SELECT')) - 1 AS s, regexp_matches(upper(sql), '\\bWITH\\b\\s+\\w+\\s+AS\\s*\\(') AS c,
            regexp_matches(upper(sql), '\\bOVER\\s*\\(') AS w,
            list_sort(list_distinct(regexp_extract_all(sql, '(?i)(?:FROM|JOIN)\\s+([a-zA-Z_][\\w.]*)', 1))) AS tables FROM log),
    o AS (SELECT *, {_OPERATION_SQL} AS ops FROM f)
"""


@query(
    "statement_features",
    "L1 F3",
    f"""
    WITH {_FEATURES}
    SELECT stmt_id, j AS join_count, s AS subquery_count, c AS has_cte, w AS has_window,
           array_to_string(tables, ',') AS tables, array_to_string(ops, ',') AS operations FROM o
    """,
)
def statement_features(t):
    found = Q.features(statement_log(t)).drop("sql")
    return found.withColumn("tables", F.array_join("tables", ",")).withColumn("operations", F.array_join("operations", ","))


@query(
    "statement_complexity",
    "L2",
    f"""
    WITH {_FEATURES},
    p AS (SELECT *, j * 2 + s * 3 + CASE WHEN w THEN 2 ELSE 0 END + CASE WHEN c THEN 1 ELSE 0 END + len(ops) AS score FROM o)
    SELECT stmt_id, score,
      CASE WHEN score <= 5 THEN 'simple' WHEN score <= 15 THEN 'moderate' WHEN score <= 30 THEN 'complex' ELSE 'very_complex' END AS complexity,
      CASE WHEN score <= 5 THEN LEAST(score * 5, 20) WHEN score <= 15 THEN LEAST(score * 4, 50) WHEN score <= 30 THEN LEAST(score * 3, 80)
           ELSE LEAST(score * 2, 100) END AS estimated_cost,
      array_to_string(list_filter([CASE WHEN j >= 5 THEN 'many_joins' END, CASE WHEN contains(u, 'SELECT *') THEN 'select_star' END,
        CASE WHEN s >= 3 THEN 'nested_subqueries' END, CASE WHEN regexp_matches(u, '\\bNOT\\s+IN\\s*\\(SELECT') THEN 'not_in_subquery' END,
        CASE WHEN regexp_matches(u, '\\bOR\\b') AND contains(u, 'WHERE') THEN 'or_in_where' END], lambda x: x IS NOT NULL), ',') AS warnings,
      array_to_string(list_filter([CASE WHEN j >= 3 THEN 'multi-table joins' END,
        CASE WHEN list_contains(ops, 'aggregation') AND j > 0 THEN 'join + aggregation combination' END,
        CASE WHEN s >= 2 THEN 'nested sub-queries' END,
        CASE WHEN list_contains(ops, 'sorting') AND list_contains(ops, 'aggregation') THEN 'sort after aggregation' END], lambda x: x IS NOT NULL), ',') AS bottlenecks
    FROM p
    """,
)
def statement_complexity(t):
    scored = Q.complexity(Q.features(statement_log(t)))
    return scored.select(
        "stmt_id",
        "score",
        "complexity",
        "estimated_cost",
        F.array_join("warnings", ",").alias("warnings"),
        F.array_join("bottlenecks", ",").alias("bottlenecks"),
    )


# Statements that hide what they do, or seem to hide something: (text, reads only, several statements, permitted DDL).
_TRICKY = (
    ("WITH x AS (SELECT '1' AS a) INSERT/**/INTO t_# SELECT a FROM x", False, False, False),
    (r"WITH x AS (SELECT r'\' AS a) INSERT INTO t_# SELECT a FROM x WHERE a <> 'z'", False, False, False),
    ("WITH x(a) AS (SELECT f(1, (2))),y AS (SELECT * FROM x) SELECT delete FROM y /* INSERT INTO /* t */ ( */", True, False, False),
    ("SELECT ';' AS `INSERT INTO t_#`, \"it's -- here\" FROM t -- ; DROP TABLE t", True, False, False),
    ("SELECT 1; DROP TABLE t_#", True, True, False),
    ("WITH gone AS (DELETE FROM t_# RETURNING *) SELECT * FROM gone", False, False, False),
    ("SELECT * INTO copy_# FROM t", False, False, False),
    ("SELECT 'never closed FROM t_#", False, False, False),
    ("CREATE TABLE t_# (a INT)", False, False, True),
    ("WITH x AS (SELECT 1) FROM x INSERT OVERWRITE t_# SELECT 1", False, False, False),
)


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tricky_log(t):
    text = F.element_at(F.array(*(F.lit(s[0]) for s in _TRICKY)), (F.col("event_id") % len(_TRICKY)).cast("int") + 1)
    return t.events.select(F.col("event_id").alias("stmt_id"), F.replace(text, F.lit("#"), F.col("user_id").cast("string")).alias("sql"))


@query(
    "statement_safety",
    "L3 P10",
    f"""
    WITH {_LOG},
    known AS (SELECT * FROM (VALUES {", ".join(f"({i}, {r}, {m}, {d})" for i, (_, r, m, d) in enumerate(_TRICKY))}) v(i, reads, several, ddl))
    SELECT 'plain' AS log, stmt_id, opens AND NOT writes AS read_only, several AS multi_statement,
           starts_with(upper(sql), 'CREATE TABLE') AS permitted_ddl, opens AND NOT writes AND NOT several AS runs_as_query
    FROM (SELECT stmt_id, sql, starts_with(upper(sql), 'SELECT') OR starts_with(upper(sql), 'WITH') AS opens,
                 contains(rtrim(bare, ';'), ';') AS several,
                 regexp_matches(upper(bare), 'INSERT (INTO|OVERWRITE)|MERGE INTO|DELETE FROM|UPDATE .* SET ') AS writes
          FROM (SELECT *, regexp_replace(sql, '''[^'']*''', '''''', 'g') AS bare FROM log))
    UNION ALL SELECT 'tricky', event_id, reads, several, ddl, reads AND NOT several FROM events JOIN known ON i = event_id % {len(_TRICKY)}
    """,
)
def statement_safety(t):
    plain, tricky = (Q.safety(log).withColumn("log", F.lit(name)) for name, log in (("plain", statement_log(t)), ("tricky", tricky_log(t))))
    return plain.unionByName(tricky)


@query(
    "edges_from_log",
    "N1",
    """
    WITH u AS (SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS id FROM events)
    SELECT 'ods_events_' || id AS src, 'dwd_views_' || id AS dst, 'INSERT INTO' AS rel FROM u WHERE event_type = 'view'
    UNION ALL SELECT 'dim_user', 'dwd_views_' || id, 'INSERT INTO' FROM u WHERE event_type = 'view'
    UNION ALL SELECT 'ods_events_' || id, 'dws_purchase_' || id, 'INSERT INTO' FROM u WHERE event_type = 'purchase'
    UNION ALL SELECT d, 'dws_purchase_' || id, 'INSERT INTO' FROM u, (VALUES ('dim_a'), ('dim_b'), ('dim_c'), ('dim_d'), ('dim_e')) v(d) WHERE event_type = 'purchase'
    UNION ALL SELECT 'dwd_views_' || id, 'dws_purchase_' || id, 'INSERT INTO' FROM u WHERE event_type = 'purchase'
    UNION ALL SELECT 'dws_purchase_' || id, 'ads_signup_' || id, 'CTAS' FROM u WHERE event_type = 'signup'
    UNION ALL SELECT 'ods_events_' || id, 'dim_user', 'MERGE' FROM u WHERE event_type = 'error'
    """,
)
def edges_from_log(t):
    return L.edges_from_log(statement_log(t))


# Statements whose select lists need more than a split at commas; # is a user.
_WRITERS = {
    "click": "INSERT INTO dwd_clicks_# (uid, n) SELECT e.user_id, count(e.event_id) FROM ods_events_# e GROUP BY e.user_id",
    "view": "WITH a AS (SELECT * FROM ods_events_#),b AS (SELECT * FROM a) INSERT INTO dwd_views_# "
    "SELECT b.user_id AS uid, COALESCE(b.value, d.weight) AS v, 'x, (y FROM z' AS label FROM b, dim_kind d WHERE b.kind = d.kind",
    "purchase": "CREATE TABLE dws_purchase_# AS SELECT v.uid, CASE WHEN v.v > 1 THEN w.n ELSE 0 END AS flag, sum(v.v * (w.n + 1)) OVER (PARTITION BY v.uid) AS total "
    "FROM dwd_views_# v LEFT JOIN (SELECT n, uid FROM dwd_clicks_#) w ON v.uid = w.uid /* , dim_no n */",
    "signup": "INSERT OVERWRITE TABLE ads_signup_# SELECT DISTINCT total, uid || '-' || flag AS tag FROM dws_purchase_# UNION ALL SELECT x, y FROM other",
    "error": "SELECT user_id FROM ods_events_#",
}

_WRITTEN = """
    u AS (SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS id FROM events),
    written AS (SELECT replace(s, '#', id) AS src_table, sc AS src_column, replace(d, '#', id) AS dst_table, dc AS dst_column, f AS transform
      FROM u JOIN (VALUES
        ('click', 'ods_events_#', 'user_id', 'dwd_clicks_#', 'uid', 'direct'), ('click', 'ods_events_#', 'event_id', 'dwd_clicks_#', 'n', 'COUNT()'),
        ('view', 'ods_events_#', 'user_id', 'dwd_views_#', 'uid', 'direct'), ('view', 'ods_events_#', 'value', 'dwd_views_#', 'v', 'COALESCE()'),
        ('view', 'dim_kind', 'weight', 'dwd_views_#', 'v', 'COALESCE()'), ('purchase', 'dwd_views_#', 'uid', 'dws_purchase_#', 'uid', 'direct'),
        ('purchase', 'dwd_views_#', 'v', 'dws_purchase_#', 'flag', 'CASE'), ('purchase', 'dwd_clicks_#', 'n', 'dws_purchase_#', 'flag', 'CASE'),
        ('purchase', 'dwd_views_#', 'v', 'dws_purchase_#', 'total', 'SUM()'), ('purchase', 'dwd_clicks_#', 'n', 'dws_purchase_#', 'total', 'SUM()'),
        ('purchase', 'dwd_views_#', 'uid', 'dws_purchase_#', 'total', 'SUM()'), ('signup', 'dws_purchase_#', 'total', 'ads_signup_#', 'total', 'direct'),
        ('signup', 'dws_purchase_#', 'uid', 'ads_signup_#', 'tag', 'expression'), ('signup', 'dws_purchase_#', 'flag', 'ads_signup_#', 'tag', 'expression')
      ) v(k, s, sc, d, dc, f) ON k = event_type)
"""


def writers_log(t):
    text = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in _WRITERS.items()])
    return t.events.select(F.col("event_id").alias("stmt_id"), F.replace(text, F.lit("#"), F.col("user_id").cast("string")).alias("sql"))


@query("column_edges_from_log", "N4 N6 N7", f"WITH {_WRITTEN} SELECT * FROM written")
def column_edges_from_log(t):
    return L.column_edges_from_log(writers_log(t))


@query(
    "trace_logged_columns",
    "N4",
    f"""
    WITH {_WRITTEN},
    e AS (SELECT DISTINCT src_table || '.' || src_column AS s, dst_table || '.' || dst_column AS d FROM written),
    l1 AS (SELECT DISTINCT d AS node FROM e WHERE s = 'dim_kind.weight'),
    l2 AS (SELECT DISTINCT d AS node FROM e JOIN l1 ON s = node),
    l3 AS (SELECT DISTINCT d AS node FROM e JOIN l2 ON s = node)
    SELECT node, 1 AS depth FROM l1 UNION ALL SELECT node, 2 FROM l2 UNION ALL SELECT node, 3 FROM l3
    """,
)
def trace_logged_columns(t):
    return L.trace_columns(L.column_edges_from_log(writers_log(t)), "dim_kind", "weight").select("node", "depth")


@query(
    "safe_identifiers",
    "L3",
    """
    WITH x AS (SELECT p_partkey, replace(p_name, ' ', CASE WHEN p_size < 25 THEN '_' ELSE '-' END) AS name FROM part
               UNION ALL SELECT p_partkey, p_partkey || '_' || p_type FROM part)
    SELECT p_partkey, name, regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]{0,127}$') AS safe FROM x
    """,
)
def safe_identifiers(t):
    glued = F.replace("p_name", F.lit(" "), F.when(F.col("p_size") < 25, "_").otherwise("-"))
    numbered = F.concat(F.col("p_partkey").cast("string"), F.lit("_"), "p_type")
    names = t.part.select("p_partkey", F.explode(F.array(glued, numbered)).alias("name"))
    return names.withColumn("safe", Q.is_safe_identifier(F.col("name")))
