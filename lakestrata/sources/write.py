"""Exports, layer storage, materialised queries and views."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Storage format, compression and retention in days per layer; 0 keeps for ever.
@dataclass(frozen=True)
class LayerStorage:
    prefix: str
    name_pattern: str
    file_format: str
    compression: str
    retention_days: int
    partitioned: bool


LAYER_STORAGE = {
    "ODS": LayerStorage("ods_", r"^ods_[a-z][a-z0-9_]*$", "orc", "snappy", 90, True),
    "DWD": LayerStorage("dwd_", r"^dwd_[a-z][a-z0-9_]*$", "parquet", "snappy", 365, True),
    "DWS": LayerStorage("dws_", r"^dws_[a-z][a-z0-9_]*(?:_\d+[hdwmy])?$", "parquet", "snappy", 730, True),
    "ADS": LayerStorage("ads_", r"^ads_[a-z][a-z0-9_]*$", "parquet", "snappy", 0, False),
    "DIM": LayerStorage("dim_", r"^dim_[a-z][a-z0-9_]*$", "parquet", "snappy", 0, False),
    "TMP": LayerStorage("tmp_", r"^tmp_[a-z][a-z0-9_]*$", "parquet", "snappy", 7, False),
}

# A safe identifier, and statement openings that only read.
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]{0,127}$"
READ_ONLY_OPENINGS = ("SELECT", "WITH")

# Functions that call any method of the JVM.
CALLS_ANYTHING = {"reflect", "try_reflect", "java_method"}


def check_identifier(name: str) -> str:
    if not re.match(IDENTIFIER, name):
        raise ValueError(f"not a safe identifier: {name!r}")
    return name


def _writes(spark: SparkSession, plan) -> str | None:
    """What a parsed plan would do beside reading, or None: commands, writes, external programs, calls of JVM methods."""
    named = spark._jvm.java.lang.Class.forName
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    command, script = named(logical + "Command"), named(logical + "ScriptTransformation")
    is_plan, is_call = named(logical + "LogicalPlan"), named("org.apache.spark.sql.catalyst.analysis.UnresolvedFunction")
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        kind = node.getClass().getSimpleName()
        if is_plan.isInstance(node):
            if command.isInstance(node) or kind in ("InsertIntoStatement", "CompoundBody"):
                return kind
            if script.isInstance(node):
                return "a script"
            waiting += [x for found in (node.innerChildren(), node.expressions()) for x in map(found.apply, range(found.size()))]
        elif is_call.isInstance(node) and node.nameParts().last().lower() in CALLS_ANYTHING:
            return f"a call of {node.nameParts().last()}"
        children = node.children()
        waiting += map(children.apply, range(children.size()))
    return None


def check_read_only(spark: SparkSession, sql: str) -> str:
    """The statement without a closing semicolon; anything but one SELECT or WITH that only reads is refused.

    Spark's own parser says what the statement is, so literals, comments and quoted names cannot hide a write. Nothing is run.
    """
    statement = sql.strip().rstrip(";").strip()
    if not statement.upper().startswith(READ_ONLY_OPENINGS):
        raise ValueError("only SELECT or WITH is accepted")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except (ParseException, Py4JJavaError) as e:
        raise ValueError(f"not a single statement that Spark can read: {e}") from e
    if found := _writes(spark, plan):
        raise ValueError(f"a statement that does more than read is not accepted: {found}")
    return statement


def select(spark: SparkSession, sql: str, **arguments) -> DataFrame:
    """One read-only statement, with named parameters."""
    statement = check_read_only(spark, sql)
    return spark.sql(statement, args=arguments) if arguments else spark.sql(statement)


def export_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


#: How CSV is written and read back: quotes are doubled, blanks stay, null is nothing and an empty text is two quotes.
CSV_OPTIONS = {
    "header": "true", "quote": '"', "escape": '"', "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


FILE_BYTES = 32 << 20  # text of a CSV file; one with line breaks is read by one task


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists", file_bytes: int = FILE_BYTES) -> None:
    """CSV part files, each with a header line; ``read_csv`` gives the same rows back.

    Rows are dealt to as many files as their texts need at ``file_bytes`` each, for a file whose values hold line breaks cannot be split.
    """
    texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    size = df.agg(F.sum(sum(texts, F.lit(16 * len(df.columns)).cast("long")))).first()[0] or 0
    files = df.repartition(-(-size // file_bytes)) if size else df
    files.write.mode(mode).options(**CSV_OPTIONS).option("emptyValue", '""').csv(path)


def write_layer(df: DataFrame, layer: str, path: str, partition_by: Sequence[str] = ("dt",), mode: str = "overwrite") -> None:
    """Write in the layer's format. Only the partitions present in ``df`` are replaced.

    The rows are not reshuffled for the write: a business date that holds most of the rows stays
    spread over all tasks.
    """
    storage = LAYER_STORAGE[layer]
    writer = df.write.format(storage.file_format).option("compression", storage.compression).mode(mode)
    if storage.partitioned and partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def create_table_as(
    spark: SparkSession, name: str, sql: str, comment: str | None = None, path: str | None = None
) -> tuple[int, list[str]]:
    """Materialise a query as a table, replacing it; returns row count and column names."""
    check_identifier(name)
    writer = select(spark, sql).write.mode("overwrite")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    if comment:
        quoted = comment.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"COMMENT ON TABLE {name} IS '{quoted}'")
    table = spark.table(name)
    return table.count(), table.columns


def create_view(spark: SparkSession, name: str, sql: str, replace: bool = True) -> DataFrame:
    check_identifier(name)
    view = select(spark, sql)
    if replace:
        view.createOrReplaceTempView(name)
    else:
        view.createTempView(name)
    return spark.table(name)
