"""Rollups, profiles, pivots and string aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns that are neither dimension nor metric.
TECHNICAL_COLUMNS = ("row_key", "etl_time")


@dataclass(frozen=True)
class AggregationRule:
    """One declared metric: ``function(source)`` per group and time bucket."""

    metric: str
    function: str
    source: str
    group_by: tuple[str, ...] = field(default_factory=tuple)
    granularity: str = "1d"


def rollup(df: DataFrame, rules: Sequence[AggregationRule], time_column: str | None = None) -> DataFrame:
    """All rules that share a grain, computed in one aggregation.

    ``granularity`` 1d / 1w / 1m / 1y / 1h truncates ``time_column`` into ``stat_time``. Trailing
    spans such as 7d are built from the 1d result by ``windows.trailing_days``.
    """
    grains = {(r.group_by, r.granularity) for r in rules}
    if len(grains) != 1:
        raise ValueError("rules of one rollup must share group_by and granularity")
    (dims, granularity), = grains
    keys: list[Column] = [F.col(d) for d in dims]
    if time_column:
        units = {"1h": "hour", "1d": "day", "1w": "week", "1m": "month", "1y": "year"}
        keys.append(F.date_trunc(units[granularity], F.col(time_column)).cast("timestamp_ntz").alias("stat_time"))
    return df.groupBy(*keys).agg(*[_metric(r) for r in rules])


def _metric(rule: AggregationRule) -> Column:
    source = F.col(rule.source) if rule.source != "*" else F.lit(1)
    functions = {
        "SUM": F.sum,
        "COUNT": F.count,
        "AVG": F.avg,
        "MIN": F.min,
        "MAX": F.max,
        "COUNT_DISTINCT": F.count_distinct,
        "APPROX_COUNT_DISTINCT": F.approx_count_distinct,
    }
    return functions[rule.function.upper()](source).alias(rule.metric)


@dataclass(frozen=True)
class InferredRollup:
    dimensions: tuple[str, ...]
    summed: tuple[str, ...]
    counted: tuple[str, ...]


def infer_rollup(schema: T.StructType, primary_key: Sequence[str] = ()) -> InferredRollup:
    """Guess dimensions and metrics from types alone.

    Numeric columns are metrics: exact and floating decimals are summed, integers are counted
    because they are usually identifiers. Everything else is a dimension. A table with numeric
    columns only is grouped by its first column. Prefer declared rules where they are known.
    """
    skipped = set(primary_key) | set(TECHNICAL_COLUMNS) | {"dt"}
    dims, summed, counted = [], [], []
    for f in schema.fields:
        if f.name in skipped:
            continue
        if not isinstance(f.dataType, T.NumericType):  # text, times, intervals, lists, structs
            dims.append(f.name)
        elif isinstance(f.dataType, (T.FractionalType, T.DecimalType)):
            summed.append(f.name)
        else:
            counted.append(f.name)
    if not dims:
        dims = [next(f.name for f in schema.fields if f.name not in TECHNICAL_COLUMNS)]
    return InferredRollup(tuple(dims), tuple(summed), tuple(counted))


def apply_inferred(df: DataFrame, plan: InferredRollup) -> DataFrame:
    metrics = [F.sum(c).alias(c) for c in plan.summed] + [F.count(c).alias(c) for c in plan.counted]
    grouped = df.groupBy(*plan.dimensions)
    return grouped.agg(*metrics) if metrics else df.select(*plan.dimensions).distinct()


def _as_text(c: Column, kind: T.DataType) -> Column:
    """Text that reads back as the same value; NaN, the largest double, stays NaN."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Rows, NULL ratio, distinct count, min and max of each column.

    Exact mode runs one small plan per column. Each reads its own column only, so together they
    read the table once, and values are counted before the shuffle, so a value that fills a third
    of the rows travels as one row per task. Approximate mode takes a single pass with sketches.
    """
    names = list(columns or df.columns)
    if approximate:
        return _profile_single_pass(df, names)
    parts = [_profile_exact(df, c) for c in names]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _profile_exact(df: DataFrame, name: str) -> DataFrame:
    kind = df.schema[name].dataType
    value = F.col("value")
    counted = df.select(F.col(name).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return counted.agg(
        F.lit(name).alias("column_name"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(value.isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count(value).alias("distinct_count"),
        _as_text(F.min(value), kind).alias("min_value"),
        _as_text(F.max(value), kind).alias("max_value"),
    ).withColumn("null_ratio", _null_ratio())


def _null_ratio() -> Column:
    return F.coalesce(F.try_divide(F.col("null_count").cast("double"), F.col("row_count").cast("double")), F.lit(0.0))


def _profile_single_pass(df: DataFrame, names: list[str]) -> DataFrame:
    entries = []
    for name in names:
        c, kind = F.col(name), df.schema[name].dataType
        entries.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.count("*").alias("row_count"),
                F.count_if(c.isNull()).alias("null_count"),
                F.approx_count_distinct(c).alias("distinct_count"),
                _as_text(F.min(c), kind).alias("min_value"),
                _as_text(F.max(c), kind).alias("max_value"),
            )
        )
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e")).withColumn("null_ratio", _null_ratio())


# Fixed value: assumed bytes per row where storage statistics are missing.
FALLBACK_ROW_BYTES = 64


def stored_bytes(df: DataFrame) -> int | None:
    """Size of the files that a frame reads straight from, each once; None if it is not read from files."""
    try:
        files = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).groupBy("path").agg(F.max("size").alias("size"))
        return files.agg(F.sum("size")).first()[0]
    except AnalysisException:
        return None


def table_statistics(df: DataFrame, table: str, size_bytes: int | None = None) -> DataFrame:
    """Row count, size and average row size; the size is that of the files, and estimated only where there are none."""
    size_bytes = stored_bytes(df) if size_bytes is None else size_bytes
    rows = df.agg(F.count("*").alias("row_count"))
    size = F.lit(size_bytes).cast("long") if size_bytes is not None else F.col("row_count") * FALLBACK_ROW_BYTES
    return rows.select(
        F.lit(table).alias("table_name"),
        "row_count",
        size.alias("size_bytes"),
        F.when(F.col("row_count") > 0, size.cast("double") / F.col("row_count")).alias("avg_row_bytes"),
    )


def analyzed_statistics(spark, table: str) -> tuple[int | None, int | None]:
    """(rows, bytes) of a catalog table after ``ANALYZE TABLE``, read from the metastore."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Statistics'")
    parsed = described.select(
        F.regexp_extract("data_type", r"(\d+) rows", 1).try_cast("long").alias("rows"),
        F.regexp_extract("data_type", r"(\d+) bytes", 1).try_cast("long").alias("bytes"),
    ).first()
    return (parsed["rows"], parsed["bytes"]) if parsed else (None, None)


def pivot_sum(df: DataFrame, key: str, header: str, values: Sequence[str], metric: Column) -> DataFrame:
    """One column per header value. The values are listed so no extra pass has to find them."""
    return df.groupBy(key).pivot(header, list(values)).agg(metric).na.fill(0)


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def distinct_list(df: DataFrame, keys: Sequence[str], value: str, position: Column, out: str) -> DataFrame:
    """Comma-joined distinct values per key, ordered by their smallest position.

    Values are made unique before they are collected, so the list holds one entry per distinct
    value however many rows the key has.
    """
    unique = df.groupBy(*keys, value).agg(F.min(position).alias("_pos"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("_pos"), F.col(value))))
    joined = F.array_join(F.transform(entries, lambda x: x[value].cast("string")), ",")
    return unique.groupBy(*keys).agg(joined.alias(out))


def row_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows two tables share, counted as a multiset over their common columns.

    Both sides are counted per distinct row before the one shuffle, so copies of a row cost one
    record per task and no join has to pair them up.
    """
    names_b = {c.lower(): c for c in b.columns}
    common = [(c, names_b[c.lower()]) for c in a.columns if c.lower() in names_b]
    left = a.select(*[F.col(x).alias(x.lower()) for x, _ in common], F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    right = b.select(*[F.col(y).alias(x.lower()) for x, y in common], F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    counted = (
        left.union(right).groupBy(*[x.lower() for x, _ in common]).agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"))
    )
    shared = F.coalesce(F.sum(F.least("n_a", "n_b")), F.lit(0))
    rows_a, rows_b = F.coalesce(F.sum("n_a"), F.lit(0)), F.coalesce(F.sum("n_b"), F.lit(0))
    return counted.agg(rows_a.alias("rows_a"), rows_b.alias("rows_b"), shared.alias("rows_shared")).withColumn(
        "overlap", F.coalesce(F.try_divide(F.col("rows_shared").cast("double"), F.least("rows_a", "rows_b").cast("double")), F.lit(0.0))
    )
