"""Cleansing steps between layers: renames, casts, defaults, rules and custom functions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestrata.functions.text import snake_name


def rename_snake(df: DataFrame) -> DataFrame:
    """Every column under its snake_case name."""
    return df.select(*[F.col(f"`{c}`").alias(snake_name(c)) for c in df.columns])


def map_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Projection that renames: new name -> source column."""
    return df.select(*[F.col(src).alias(dst) for dst, src in mapping.items()])


def standardise_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """``try_cast`` of the named columns; a value that does not fit becomes NULL."""
    return df.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def cast_failures(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Per column: how many values are present but do not fit the target type. One pass."""
    failed = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(kind).alias("target_type"),
            F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull()).alias("failed"),
        )
        for c, kind in types.items()
    ]
    return df.agg(F.array(*failed).alias("f")).select(F.inline("f"))


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """COALESCE with a default per column, in the column's own type."""
    return df.select(
        *[
            F.coalesce(F.col(c), F.lit(defaults[c]).cast(df.schema[c].dataType)).alias(c) if c in defaults else F.col(c)
            for c in df.columns
        ]
    )


@dataclass(frozen=True)
class RowRule:
    """``filter`` keeps rows where the expression is true; any other kind sets ``target``."""

    kind: str
    expression: str
    target: str = ""


def apply_row_rules(df: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    for rule in rules:
        condition = F.expr(rule.expression)
        df = df.where(condition) if rule.kind == "filter" else df.withColumn(rule.target, condition)
    return df


@dataclass(frozen=True)
class SqlRule:
    """SQL over ``{input}``, the frame that the rule before it produced."""

    sql: str
    order: int = 0


def apply_sql_rules(df: DataFrame, rules: Sequence[SqlRule]) -> DataFrame:
    for rule in sorted(rules, key=lambda r: r.order):
        df = df.sparkSession.sql(rule.sql, input=df)
    return df


def apply_function(df: DataFrame, fn: Callable[..., DataFrame], **arguments) -> DataFrame:
    """A user function from frame to frame."""
    return df.transform(fn, **arguments)


def apply_per_batch(df: DataFrame, fn: Callable, schema: T.StructType | str) -> DataFrame:
    """A pandas function over Arrow batches, for row logic that no Spark function states."""

    def run(batches):
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def apply_per_group(df: DataFrame, keys: Sequence[str], fn: Callable, schema: T.StructType | str) -> DataFrame:
    """A pandas function over whole groups.

    Each group is loaded by one task, so the keys must be fine enough for that; add a bucket of
    the rows to the keys, or aggregate first, where a key can hold a large share of the table.
    """
    return df.groupBy(*keys).applyInPandas(fn, schema)
