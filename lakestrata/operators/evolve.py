"""Schema differences and conforming data to a target schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestrata.functions.text import present


def columns_frame(df: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name, data_type, comment, position) of one frame."""
    rows = [
        (table, f.name, f.dataType.simpleString().upper(), (f.metadata or {}).get("comment", ""), i)
        for i, f in enumerate(df.schema.fields)
    ]
    kind = "table_name string, column_name string, data_type string, comment string, position int"
    return df.sparkSession.createDataFrame(rows, kind)


def diff_schemas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Column changes of many tables at once: added, removed, type and comment.

    Inputs have (table_name, column_name, data_type, comment). Names compare exactly. A comment
    counts as changed only when the new one is not empty. Swap the arguments for the inverse.
    """
    keys = ["table_name", "column_name"]
    old = before.select(*keys, F.col("data_type").alias("from_type"), F.col("comment").alias("_c0"), F.lit(1).alias("_old"))
    new = after.select(*keys, F.col("data_type").alias("to_type"), F.col("comment").alias("_c1"), F.lit(1).alias("_new"))
    both = old.join(new, keys, "full_outer")
    stays = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    commented = ~F.col("_c0").eqNullSafe(F.col("_c1")) & (F.coalesce(F.col("_c1"), F.lit("")) != "")
    changes = present(
        F.array(
            F.when(F.col("_old").isNull(), "added"),
            F.when(F.col("_new").isNull(), "removed"),
            F.when(stays & ~F.col("from_type").eqNullSafe(F.col("to_type")), "type_changed"),
            F.when(stays & commented, "comment_changed"),
        )
    )
    return both.select(*keys, F.explode(changes).alias("change"), "from_type", "to_type")


def conform(df: DataFrame, target: T.StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """The target's columns in the target's order: cast, added as default or NULL, or dropped."""
    given = defaults or {}
    columns = []
    for f in target.fields:
        if f.name in df.columns:
            columns.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
        else:
            columns.append(F.lit(given.get(f.name)).cast(f.dataType).alias(f.name))
    return df.select(*columns)
