"""Features, complexity and safety of the statements in a query log of (stmt_id, sql)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestrata.functions import statements as S
from lakestrata.functions.text import count_pattern, present
from lakestrata.sources.write import IDENTIFIER

# DDL statements that may run.
DDL_OPENINGS = (
    "CREATE TABLE", "CREATE VIEW", "CREATE INDEX", "CREATE SEQUENCE", "CREATE SCHEMA",
    "CREATE OR REPLACE VIEW", "CREATE OR REPLACE TABLE", "DROP TABLE", "DROP VIEW", "DROP INDEX",
    "DROP SCHEMA", "ALTER TABLE", "ALTER VIEW", "COMMENT ON",
)

# Upper score bound, class name, cost per point and cost limit.
COMPLEXITY = (
    (5, "simple", 5, 20),
    (15, "moderate", 4, 50),
    (30, "complex", 3, 80),
    (None, "very_complex", 2, 100),
)


def features(log: DataFrame) -> DataFrame:
    """Counts, flags, operations and referenced tables of each statement.

    ``subquery_count`` is the number of SELECT words less one, so a statement without SELECT has -1.
    """
    upper = F.upper("sql")
    counted = log.select(
        "stmt_id",
        "sql",
        count_pattern(upper, r"\bJOIN\b").alias("join_count"),
        (count_pattern(upper, "SELECT") - 1).alias("subquery_count"),
        upper.rlike(r"\bWITH\b\s+\w+\s+AS\s*\(").alias("has_cte"),
        upper.rlike(r"\bOVER\s*\(").alias("has_window"),
        F.array_sort(F.array_distinct(F.regexp_extract_all("sql", F.lit(r"(?i)(?:FROM|JOIN)\s+([a-zA-Z_][\w.]*)"), F.lit(1)))).alias("tables"),
    )
    # Operation labels, in output order.
    seen = (
        ("aggregation", upper.contains("GROUP BY")),
        ("sorting", upper.contains("ORDER BY")),
        ("deduplication", upper.contains("DISTINCT")),
        ("join", F.col("join_count") > 0),
        ("subquery", F.col("subquery_count") > 0),
        ("window_function", F.col("has_window")),
        ("cte", F.col("has_cte")),
        ("union", upper.contains("UNION")),
        ("pattern_match", upper.rlike(r"\bLIKE\b")),
        ("existence_check", upper.contains("EXISTS")),
        ("conditional_logic", upper.contains("CASE")),
    )
    return counted.withColumn("operations", present(F.array(*(F.when(test, label) for label, test in seen))))


def complexity(featured: DataFrame) -> DataFrame:
    """Score, class, estimated cost, warnings and bottlenecks from the features."""
    joins, subqueries = F.col("join_count"), F.col("subquery_count")
    points = (
        joins * 2
        + subqueries * 3
        + F.when(F.col("has_window"), 2).otherwise(0)
        + F.when(F.col("has_cte"), 1).otherwise(0)
        + F.size("operations")
    )
    upper = F.upper("sql")
    has = lambda op: F.array_contains("operations", op)
    warnings = present(
        F.array(
            F.when(joins >= 5, "many_joins"),
            F.when(upper.contains("SELECT *"), "select_star"),
            F.when(subqueries >= 3, "nested_subqueries"),
            F.when(upper.rlike(r"\bNOT\s+IN\s*\(SELECT"), "not_in_subquery"),
            F.when(upper.rlike(r"\bOR\b") & upper.contains("WHERE"), "or_in_where"),
        )
    )
    bottlenecks = present(
        F.array(
            F.when(joins >= 3, "multi-table joins"),
            F.when(has("aggregation") & (joins > 0), "join + aggregation combination"),
            F.when(subqueries >= 2, "nested sub-queries"),
            F.when(has("sorting") & has("aggregation"), "sort after aggregation"),
        )
    )
    scored = featured.withColumn("score", points.cast("long"))
    return scored.select(
        *featured.columns,
        "score",
        _by_score(lambda name, per_point, limit: F.lit(name)).alias("complexity"),
        _by_score(lambda name, per_point, limit: F.least(F.col("score") * per_point, F.lit(limit))).cast("long").alias("estimated_cost"),
        warnings.alias("warnings"),
        bottlenecks.alias("bottlenecks"),
    )


def _by_score(value) -> Column:
    chosen = None
    for bound, name, per_point, limit in COMPLEXITY:
        result = value(name, per_point, limit)
        if bound is None:
            return chosen.otherwise(result)
        test = F.col("score") <= bound
        chosen = F.when(test, result) if chosen is None else chosen.when(test, result)
    raise ValueError("the last complexity class must have no bound")


def safety(log: DataFrame) -> DataFrame:
    """Whether a statement only reads, holds several statements, or is permitted DDL.

    For logs of any size, from the text alone; ``check_read_only`` asks Spark's parser about one statement. A text
    that several statements stand in does not run as a query, whatever they do. A null text is none of these.
    """
    upper = F.upper(F.trim("sql"))
    ddl = F.lit(False)
    for opening in DDL_OPENINGS:
        ddl = ddl | upper.startswith(opening)
    texts = log.select("stmt_id", ddl.alias("permitted_ddl"), S.without_names(S.bare(F.trim("sql"))).alias("text"))
    flat = texts.withColumn("flat", S.outline(F.col("text")))
    read_only, several = S.reads_only(F.col("text"), F.col("flat")), S.several(F.col("text"))
    found = flat.select("stmt_id", read_only.alias("read_only"), several.alias("multi_statement"), "permitted_ddl")
    found = found.fillna(False, ["read_only", "multi_statement", "permitted_ddl"])
    return found.withColumn("runs_as_query", F.col("read_only") & ~F.col("multi_statement"))


def is_safe_identifier(name: Column) -> Column:
    return name.rlike(IDENTIFIER)
