"""Convention audit of a columns table: rule violations and a score per table."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestrata.functions.text import CASE_PATTERNS, LAYER_PREFIXES, layer_of, matches_any_glob
from lakestrata.sources.write import LAYER_STORAGE

# Words that may not be part of a name.
RESERVED_WORDS = (
    "order", "group", "select", "table", "index", "user", "key", "from", "where", "insert", "update",
    "delete", "drop", "create", "alter", "join", "union", "values", "set", "null", "true", "false",
    "case", "when", "then", "else", "end", "like", "between", "exists", "having", "limit", "offset",
)

# Column types that are not accepted.
FORBIDDEN_TYPES = ("TEXT", "BLOB", "MEDIUMTEXT", "LONGTEXT", "MEDIUMBLOB", "LONGBLOB")

# Column types by engine for the logical types STRING, INTEGER, BIGINT, FLOAT, DOUBLE,
# DECIMAL, BOOLEAN, DATE, TIMESTAMP and JSON.
ENGINE_TYPES = {
    "clickhouse": ("String", "Int32", "Int64", "Float32", "Float64", "Decimal(18, 2)", "UInt8", "Date", "DateTime", "String"),
    "hive": ("STRING", "INT", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL(18, 2)", "BOOLEAN", "DATE", "TIMESTAMP", "STRING"),
    "mysql": ("VARCHAR(255)", "INT", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL(18, 2)", "TINYINT(1)", "DATE", "DATETIME", "JSON"),
    "postgresql": ("VARCHAR(255)", "INTEGER", "BIGINT", "REAL", "DOUBLE PRECISION", "NUMERIC(18, 2)", "BOOLEAN", "DATE", "TIMESTAMP", "JSONB"),
    "doris": ("VARCHAR(255)", "INT", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL(18, 2)", "BOOLEAN", "DATE", "DATETIME", "STRING"),
    "duckdb": ("VARCHAR", "INTEGER", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL(18, 2)", "BOOLEAN", "DATE", "TIMESTAMP", "VARCHAR"),
}

# Penalties per violation.
PENALTIES = {"error": 15, "warning": 5, "info": 1}


@dataclass(frozen=True)
class Convention:
    """Rules of the audit; the defaults are the standard convention."""

    case_style: str = "snake_case"
    prefixes: Mapping[str, str] = field(default_factory=lambda: {k: v for k, v in LAYER_PREFIXES.items() if k != "TMP"})
    reserved_words: tuple[str, ...] = RESERVED_WORDS
    forbidden_types: tuple[str, ...] = FORBIDDEN_TYPES
    engine: str = "hive"
    engine_types: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: ENGINE_TYPES)
    strict_compat: bool = False
    table_comment_required: bool = True
    column_comment_required: bool = True
    table_comment_template: str | None = "[{layer}] {description}"
    column_comment_min_length: int = 3
    partition_by_layer: Mapping[str, str] = field(
        default_factory=lambda: {"ODS": "dt", "DWD": "dt", "DWS": "stat_date", "ADS": "stat_date"}
    )
    primary_key_required: bool = True
    not_null_globs: tuple[str, ...] = ("*_id", "*_key", "dt", "etl_time")
    unique_globs: tuple[str, ...] = ("*_sk",)
    formats: Mapping[str, str] = field(
        default_factory=lambda: {"clickhouse": "MergeTree", "hive": "ORC", "doris": "", "mysql": "InnoDB", "postgresql": "", "duckdb": ""}
    )
    codecs: Mapping[str, str] = field(default_factory=lambda: {"clickhouse": "LZ4", "hive": "SNAPPY"})


@dataclass(frozen=True)
class Rule:
    """One rule as a condition that is true where it is broken."""

    name: str
    severity: str
    broken: Column


def _broken_rules(rules: list[Rule]) -> Column:
    """Generator of one (rule, severity) row per rule; rules that hold give a NULL row."""
    return F.inline(
        F.array(*[F.when(r.broken, F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"))) for r in rules])
    )


def _count(rules: list[Rule], severity: str) -> Column:
    """How many rules of a severity a row breaks."""
    total = F.lit(0).cast("long")
    for r in rules:
        if r.severity == severity:
            total = total + F.when(r.broken, 1).otherwise(0)
    return total


def _has_reserved(name: Column, words: tuple[str, ...]) -> Column:
    """A reserved word as a whole part of the name, parts being split at ``_``, ``-`` and blanks."""
    union = "|".join(re.escape(w.lower()) for w in words)
    return F.lower(name).rlike(rf"(?:^|[_\-\s])(?:{union})(?:[_\-\s]|$)")


def _breaks_case(name: Column, style: str) -> Column:
    pattern = CASE_PATTERNS.get(style)
    return ~name.rlike(pattern) if pattern else F.lit(False)


def template_regex(template: str) -> str:
    """``[{layer}] {description}`` as a regular expression: each placeholder is some text."""
    return ".+".join(re.escape(part) for part in re.split(r"\{\w+\}", template))


def _column_rules(c: Convention) -> list[Rule]:
    name, comment = F.col("column_name"), F.coalesce(F.col("column_comment"), F.lit(""))
    kind = F.upper(F.trim(F.coalesce(F.col("data_type"), F.lit(""))))
    base = F.split(kind, r"[(\s]")[0]
    forbidden = [t.upper() for t in c.forbidden_types]
    is_forbidden = kind.isin(*forbidden)
    for t in forbidden:
        is_forbidden = is_forbidden | kind.startswith(f"{t}(")
    known = [t.upper() for t in c.engine_types.get(c.engine, ()) if t]
    if not c.strict_compat:
        known = [re.split(r"[(\s]", t)[0] for t in known]
    unknown = (kind != "") & ~base.isin(*known) & ~base.isin(*forbidden) if known else F.lit(False)
    blank = F.trim(comment) == ""
    no_comment = blank if c.column_comment_required else F.lit(False)
    short = ~no_comment & (comment != "") & (F.length(F.trim(comment)) < c.column_comment_min_length)
    return [
        Rule("naming.column_case", "warning", _breaks_case(name, c.case_style)),
        Rule("naming.reserved_word_column", "error", _has_reserved(name, c.reserved_words)),
        Rule("datatype.forbidden", "error", is_forbidden),
        Rule("datatype.unknown_for_engine", "warning", unknown),
        Rule("comment.column_required", "warning", no_comment),
        Rule("comment.column_min_length", "info", short),
        Rule("quality.not_null", "warning", matches_any_glob(name, c.not_null_globs) & F.col("nullable")),
        Rule("quality.unique_hint", "info", matches_any_glob(name, c.unique_globs)),
    ]


def _table_rules(c: Convention, declared: bool) -> list[Rule]:
    name, comment = F.col("table_name"), F.coalesce(F.col("table_comment"), F.lit(""))
    layer = layer_of(name, c.prefixes)
    expected = F.coalesce(*[F.when(layer == k, F.lit(v)) for k, v in c.partition_by_layer.items()])
    keys = F.coalesce(F.col("partition_keys"), F.array().cast("array<string>"))
    keyed = F.size(keys) > 0
    rules = [
        Rule("naming.table_case", "error", _breaks_case(name, c.case_style)),
        Rule("naming.reserved_word_table", "error", _has_reserved(name, c.reserved_words)),
        Rule("comment.table_required", "error", F.lit(c.table_comment_required) & (F.trim(comment) == "")),
        Rule("partition.column_mismatch", "warning", keyed & expected.isNotNull() & ~F.array_contains(keys, expected)),
        Rule("partition.missing", "info", ~keyed & expected.isNotNull()),
        Rule("quality.primary_key_required", "warning", F.lit(c.primary_key_required) & ~F.col("has_key")),
    ]
    if c.table_comment_template:
        rules.append(Rule("comment.table_pattern", "warning", (comment != "") & ~comment.rlike(template_regex(c.table_comment_template))))
    for rule, column, wanted in (
        ("storage.format", "storage_format", c.formats),
        ("storage.compression", "compression", c.codecs),
    ):
        if c.engine in wanted:
            given = F.coalesce(F.col(column), F.lit(""))
            rules.append(Rule(rule, "info", (given != "") & (F.upper(given) != wanted[c.engine].upper())))
    if declared:
        starts = F.coalesce(*[F.when(F.col("layer") == k, name.startswith(p)) for k, p in c.prefixes.items()], F.lit(True))
        rules.append(Rule("naming.table_prefix", "error", ~starts))
    return rules


def _table_keys(columns: DataFrame) -> list[str]:
    declared = ["layer"] if "layer" in columns.columns else []
    return ["table_name", "table_comment", "partition_keys", "storage_format", "compression", *declared]


def violations(columns: DataFrame, convention: Convention | None = None) -> DataFrame:
    """(table_name, column_name, rule, severity); ``column_name`` is empty for table rules.

    ``columns`` has one row per column: table_name, table_comment, column_name, data_type, nullable,
    is_primary_key, column_comment, partition_keys, storage_format, compression, and optionally the
    declared ``layer``. What describes the table is the same on all of its rows.
    """
    c = convention or Convention()
    broken = F.col("rule").isNotNull()
    per_column = columns.select("table_name", "column_name", _broken_rules(_column_rules(c))).where(broken)
    tables = columns.groupBy(*_table_keys(columns)).agg(F.max("is_primary_key").alias("has_key"))
    rules = _table_rules(c, "layer" in columns.columns)
    per_table = tables.select("table_name", F.lit("").alias("column_name"), _broken_rules(rules)).where(broken)
    return per_column.unionByName(per_table)


def scores(columns: DataFrame, convention: Convention | None = None) -> DataFrame:
    """(table_name, errors, warnings, infos, score, is_valid) for every table, spotless ones too.

    Column rules are counted on each row and added up in the same aggregation that gathers the
    table's attributes, so the columns are shuffled once, as partial sums.
    """
    c = convention or Convention()
    column_rules, table_rules = _column_rules(c), _table_rules(c, "layer" in columns.columns)
    per_table = columns.groupBy(*_table_keys(columns)).agg(
        F.max("is_primary_key").alias("has_key"), *[F.sum(_count(column_rules, s)).alias(f"_{s}") for s in PENALTIES]
    )
    counted = per_table.select("table_name", *[(F.col(f"_{s}") + _count(table_rules, s)).alias(f"{s}s") for s in PENALTIES])
    penalty = sum((F.col(f"{s}s") * p for s, p in PENALTIES.items()), F.lit(0))
    return counted.select(
        "*", F.greatest(F.lit(0), 100 - penalty).cast("long").alias("score"), (F.col("errors") == 0).alias("is_valid")
    )


def placement_problems(tables: DataFrame) -> DataFrame:
    """(table_name, layer, rule, detail) for (table_name, layer): prefix, pattern, foreign prefix."""
    name, layer = F.col("table_name"), F.col("layer")
    prefix = F.coalesce(*[F.when(layer == k, F.lit(s.prefix)) for k, s in LAYER_STORAGE.items()])
    pattern_ok = F.coalesce(*[F.when(layer == k, name.rlike(s.name_pattern)) for k, s in LAYER_STORAGE.items()])
    foreign = F.coalesce(*[F.when((layer != k) & name.startswith(s.prefix), F.lit(s.prefix)) for k, s in LAYER_STORAGE.items()])

    def problem(rule: str, broken: Column, detail: Column) -> Column:
        return F.when(broken, F.struct(F.lit(rule).alias("rule"), detail.alias("detail")))

    found = F.array(
        problem("placement.unknown_layer", prefix.isNull(), layer),
        problem("placement.prefix", ~name.startswith(prefix), prefix),
        problem("placement.pattern", ~pattern_ok, layer),
        problem("placement.foreign_prefix", prefix.isNotNull() & foreign.isNotNull(), foreign),
    )
    return tables.select("table_name", "layer", F.inline(found)).where(F.col("rule").isNotNull())
