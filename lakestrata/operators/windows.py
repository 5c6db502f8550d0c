"""Ordered computations that stay balanced when one key holds much of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestrata.session import materialize


def orderable(schema: T.StructType, excluded: Sequence[str] = ()) -> list[str]:
    """Columns Spark can sort by, for use as tie-breaks."""
    unsortable = (T.MapType, T.VariantType)
    return [f.name for f in schema.fields if f.name not in excluded and not isinstance(f.dataType, unsortable)]


def keep_latest(
    df: DataFrame, keys: Sequence[str], order_column: str, tiebreak: Sequence[str] | None = None
) -> DataFrame:
    """The row with the greatest ``order_column`` per key.

    Ties fall to the smallest remaining columns, so the answer never depends on arrival order.
    The filter on the row number lets Spark drop all but one row per key before the shuffle.
    """
    ties = list(tiebreak) if tiebreak is not None else orderable(df.schema, [*keys, order_column])
    order = [F.col(order_column).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]]
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rn") == 1).drop("_rn")


def top_in_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, method: str = "row_number", out: str = "rank"
) -> DataFrame:
    """The first ``n`` ranks per group; losers are cut before the shuffle."""
    rank = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[method]
    ranked = df.withColumn(out, rank().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return ranked.where(F.col(out) <= n)


def hashed_row_key(df: DataFrame, natural_key: Sequence[str], out: str = "row_key") -> DataFrame:
    """Surrogate key from the natural key: no shuffle, stable across runs, not dense."""
    return df.withColumn(out, F.xxhash64(*natural_key))


def dense_row_key(df: DataFrame, order_by: Sequence[str | Column] | None = None, out: str = "row_key") -> DataFrame:
    """Surrogate key 1..n without a one-task window.

    Every row first gets its partition number and its place in that partition, and the result is
    written once so that a retried task cannot number rows differently. The count of rows per
    partition then gives each partition its offset. With ``order_by`` the rows are range-sorted
    first and the keys follow that order; end it with unique columns to make it total.
    """
    placed = df.orderBy(*order_by) if order_by else df
    marked = materialize(placed.withColumn("_place", F.monotonically_increasing_id()), "row-key")
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    per_part = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per task of the write above: at most a few hundred thousand short rows.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    keyed = marked.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return keyed.withColumn(out, F.col("_offset") + place + 1).drop("_part", "_place", "_offset")


def neighbours(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], before: dict[str, str] | None = None, after: dict[str, str] | None = None
) -> DataFrame:
    """``lag`` and ``lead`` per key in one pass, balanced however the rows fall on keys and times.

    ``before`` and ``after`` map new column names to columns of the row before and the row after. ``order_by`` must order the rows of a key
    fully. The rows are dealt to ranges of (keys, order), which sampling makes about equal, so a key, or one day of it, that
    holds much of the table covers several ranges, and written out once for both uses. Windows work within a range; only the first and the last row of each range look beyond it, in
    a frame of one row a range. Nulls are keys like others. Without neighbour the new columns are null.
    """
    before, after = before or {}, after or {}
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(ranges, *keys, *order_by).withColumn("_range", F.spark_partition_id()), "ranges")
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    behind = F.struct(key.alias("key"), *[F.col(src).alias(f"v{i}") for i, src in enumerate(before.values())])
    ahead = F.struct(key.alias("key"), *[F.col(src).alias(f"v{i}") for i, src in enumerate(after.values())])
    place = F.struct(key, *order_by)
    ends = dealt.groupBy("_range").agg(F.max_by(behind, place).alias("_last"), F.min_by(ahead, place).alias("_first"))
    by_range = Window.orderBy("_range")  # one short row a range
    beyond = ends.select("_range", F.lag("_last").over(by_range).alias("_last"), F.lead("_first").over(by_range).alias("_first"))
    inside = Window.partitionBy("_range", *keys).orderBy(*order_by)
    near = dealt.select("*", F.lag(behind).over(inside).alias("_before"), F.lead(ahead).over(inside).alias("_after"))
    near = near.withColumn("_key", key).join(F.broadcast(beyond), "_range", "left")
    same = lambda c: F.when(F.col(c)["key"].eqNullSafe(F.col("_key")), F.col(c))
    found = near.select(*df.columns, F.coalesce("_before", same("_last")).alias("_before"), F.coalesce("_after", same("_first")).alias("_after"))
    new = [F.col(side)[f"v{i}"].alias(name) for side, names in (("_before", before), ("_after", after)) for i, name in enumerate(names)]
    return found.select(*df.columns, *new)


def previous_row(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], values: dict[str, str]) -> DataFrame:
    """``lag`` per key; see ``neighbours``."""
    return neighbours(df, keys, order_by, before=values)


def next_row(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], values: dict[str, str]) -> DataFrame:
    """``lead`` per key; see ``neighbours``."""
    return neighbours(df, keys, order_by, after=values)


def attach_first_last(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], column: str, first_as: str, last_as: str
) -> DataFrame:
    """FIRST_VALUE and LAST_VALUE per key on every row, by aggregate and join back.

    The aggregate shrinks each key to one row per task before the shuffle, which a whole-partition
    window cannot do.
    """
    order = F.struct(*order_by)
    ends = df.groupBy(*[F.col(k).alias(f"_e_{k}") for k in keys]).agg(
        F.min_by(column, order).alias(first_as), F.max_by(column, order).alias(last_as)
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_e_{k}"))
    return df.join(ends, same, "left").drop(*[f"_e_{k}" for k in keys])


def trailing_days(
    daily: DataFrame, dims: Sequence[str], day: str, metrics: Sequence[str], days: int, suffix: str | None = None
) -> DataFrame:
    """Sum over the ``days`` days that end at each row's day.

    Takes rows that are already one per (dims, day), so a window partition never holds more rows
    than there are days.
    """
    tail = suffix or f"_{days}d"
    number = F.datediff(F.col(day).cast("date"), F.lit("1970-01-01").cast("date"))
    span = Window.partitionBy(*dims).orderBy(number).rangeBetween(-(days - 1), 0)
    return daily.select("*", *[F.sum(m).over(span).alias(f"{m}{tail}") for m in metrics])
