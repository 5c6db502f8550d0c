"""Slowly changing dimensions, the calendar and partition retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestrata.operators.load import upsert
from lakestrata.operators.windows import keep_latest, next_row, previous_row


def scd1(dimension: DataFrame, changes: DataFrame, keys: Sequence[str], order_column: str | None = None) -> DataFrame:
    """Type 1: the new value replaces the old one."""
    return upsert(dimension, changes, keys, order_column)


def scd2_from_history(history: DataFrame, keys: Sequence[str], attributes: Sequence[str], valid_from: str, ties: Sequence[str] = ()) -> DataFrame:
    """Type 2 (zipper) rows from a change history.

    Consecutive rows with equal attributes are one version. A version ends where the next begins
    (half-open), the last one has a NULL ``valid_to`` and ``is_current``. Of several rows with the
    same ``valid_from`` the one with the greatest ``ties`` counts. Attributes compare as values, so
    NULL equals NULL. A key with a long history is spread over several tasks.
    """
    seen = F.max_by(F.struct(*attributes), F.struct(*(ties or attributes))).alias("_seen")
    points = history.groupBy(*keys, F.col(valid_from).alias("valid_from")).agg(seen)
    return _versions(points, keys, attributes)


def _versions(points: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Versions from points (keys, valid_from, _seen: the attributes from then on, null where nothing holds), one row a key and time."""
    before = previous_row(points.withColumn("_known", F.lit(True)), keys, ["valid_from"], {"_before": "_seen", "_follows": "_known"})
    changed = before.where(F.col("_follows").isNull() | ~F.col("_seen").eqNullSafe(F.col("_before")))
    versions = next_row(changed.select(*keys, "valid_from", "_seen"), keys, ["valid_from"], {"valid_to": "valid_from"})
    return versions.where("_seen IS NOT NULL").select(
        *keys,
        *[F.col("_seen")[a].alias(a) for a in attributes],
        "valid_from",
        "valid_to",
        F.col("valid_to").isNull().alias("is_current"),
    )


def _same(a: Sequence[str], b: Sequence[str]) -> Column:
    """Equal keys, null equal to null."""
    test = F.lit(True)
    for x, y in zip(a, b):
        test = test & F.col(x).eqNullSafe(F.col(y))
    return test


def scd2_apply(
    dimension: DataFrame, changes: DataFrame, keys: Sequence[str], attributes: Sequence[str], effective: Column, ties: Sequence[str] = ()
) -> DataFrame:
    """Fold a batch of changes into a type 2 dimension.

    A change holds from ``effective``, an expression over its row, until the next known point of its key. So a key
    may have several changes in a batch, and a late one splits the version that it falls into. At the same
    time a change replaces what the dimension says, and of several changes the one with the greatest ``ties`` counts; a change
    that alters nothing leaves no trace, so applying a batch twice changes nothing. Time that no version covered stays
    uncovered up to its next point. Null is a key like others; changes without a time are left out. Only the keys in the batch
    are taken apart, all other versions pass through as they are.
    """
    columns = [*keys, *attributes, "valid_from", "valid_to", "is_current"]
    dimension = dimension.select(*columns)
    kind = dimension.schema["valid_from"].dataType
    news = changes.withColumn("_at", effective.cast(kind)).where("_at IS NOT NULL")
    seen = F.max_by(F.struct(*attributes), F.struct(*(ties or attributes))).alias("_seen")
    news = news.groupBy(*keys, F.col("_at").alias("valid_from")).agg(seen).withColumn("_rank", F.lit(2))
    touched = news.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)]).distinct()
    hit = _same(keys, touched.columns)
    untouched = dimension.join(touched, hit, "left_anti")
    known = dimension.join(touched, hit, "left_semi")
    starts = known.select(*keys, "valid_from", F.struct(*attributes).alias("_seen"), F.lit(1).alias("_rank"))
    # Where a version ends nothing holds, unless the next one or a change begins there.
    nothing = F.lit(None).cast(starts.schema["_seen"].dataType)
    ends = known.where("valid_to IS NOT NULL").select(*keys, F.col("valid_to").alias("valid_from"), nothing.alias("_seen"), F.lit(0).alias("_rank"))
    points = news.unionByName(starts).unionByName(ends)
    # A null attribute list must be able to win, so the struct is wrapped.
    settled = points.groupBy(*keys, "valid_from").agg(F.max_by(F.struct("_seen"), "_rank").alias("_top")).select(*keys, "valid_from", F.col("_top._seen").alias("_seen"))
    return untouched.unionByName(_versions(settled, keys, attributes).select(*columns))


def scd3(dimension: DataFrame, changes: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Type 3: keep the previous value beside the current one, as ``prev_<attribute>``.

    A value that does not change leaves the previous value alone. The dimension is joined with the changes as its
    left side, so a small batch is broadcast and the dimension stays where it is; keys that are new to it come from an anti join.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    news = changes.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[F.col(a).alias(f"_n_{a}") for a in attributes], F.lit(True).alias("_incoming"))
    both = dimension.join(news, _same(keys, names), "left")
    columns = []
    for c in dimension.columns:
        source = c.removeprefix("prev_")
        if c in attributes:
            columns.append(F.when(F.col("_incoming"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        elif c.startswith("prev_") and source in attributes:
            moved = F.col("_incoming") & ~F.col(source).eqNullSafe(F.col(f"_n_{source}"))
            columns.append(F.when(moved, F.col(source)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    known = dimension.select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
    fresh = changes.select(*keys, *attributes).join(known, _same(keys, names), "left_anti")
    given = {*keys, *attributes}
    added = fresh.select(*[F.col(f.name) if f.name in given else F.lit(None).cast(f.dataType).alias(f.name) for f in dimension.schema.fields])
    return both.select(*columns).unionByName(added)


def consolidate(detail: DataFrame, natural_key: Sequence[str], attributes: Sequence[str], order_column: str) -> DataFrame:
    """One dimension row per natural key: the attributes of its latest detail row."""
    narrow = detail.select(*dict.fromkeys([*natural_key, *attributes, order_column]))
    return keep_latest(narrow, natural_key, order_column).select(*natural_key, *attributes)


def date_dimension(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """One row per day between the two date columns of a one-row frame."""
    day = F.col("day")
    days = bounds.select(F.explode(F.sequence(F.col(first).cast("date"), F.col(last).cast("date"))).alias("day"))
    return days.select(
        F.date_format(day, "yyyy-MM-dd").alias("date_key"),
        F.year(day).cast("long").alias("year"),
        F.quarter(day).cast("long").alias("quarter"),
        F.month(day).cast("long").alias("month"),
        F.day(day).cast("long").alias("day_of_month"),
        (F.weekday(day) + 1).cast("long").alias("iso_weekday"),
        F.weekofyear(day).cast("long").alias("iso_week"),
        (F.weekday(day) >= 5).alias("is_weekend"),
        F.date_format(F.trunc(day, "month"), "yyyy-MM-dd").alias("month_start"),
        F.date_format(F.last_day(day), "yyyy-MM-dd").alias("month_end"),
    )


def expired_partitions(partitions: DataFrame, as_of: str, retention_days: int, partition: str = "dt") -> DataFrame:
    """Partition values past their retention; 0 days keeps everything."""
    if retention_days == 0:
        return partitions.where(F.lit(False))
    oldest = F.date_sub(F.lit(as_of).cast("date"), retention_days)
    return partitions.where(F.col(partition).try_cast("date") < oldest)


def drop_expired(spark: SparkSession, table: str, as_of: str, retention_days: int, partition: str = "dt") -> list[str]:
    """Drop the expired partitions of a catalog table; works on the partition list alone."""
    listed = spark.sql(f"SHOW PARTITIONS {table}")
    values = listed.select(F.regexp_extract("partition", rf"(?:^|/){partition}=([^/]+)", 1).alias(partition)).distinct()
    gone = sorted(r[0] for r in expired_partitions(values, as_of, retention_days, partition).collect())
    for value in gone:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({partition} = '{value}')")
    return gone
