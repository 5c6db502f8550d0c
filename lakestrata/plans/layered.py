"""The layer chain: raw (ODS), detail (DWD), summary (DWS) and application (ADS) tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestrata.operators.transform import fill_defaults, rename_snake, standardise_types
from lakestrata.operators.windows import keep_latest
from lakestrata.session import delete_path, list_names


def to_ods(source: DataFrame, etl_time: str, bizdate: str | Column, source_system: str | None = None) -> DataFrame:
    """Source columns in snake_case plus ``etl_time`` and ``dt``; optionally where they came from.

    Both stamps are job parameters, so a rerun of the same date writes the same rows.
    """
    raw = rename_snake(source)
    if source_system is not None:
        raw = raw.withColumn("source_system", F.lit(source_system))
    stamp = bizdate if isinstance(bizdate, Column) else F.lit(bizdate)
    return raw.withColumn("etl_time", F.to_timestamp_ntz(F.lit(etl_time))).withColumn("dt", stamp)


def on_date(df: DataFrame, bizdate: str) -> DataFrame:
    """One business date; a bare comparison, so partition pruning sees it."""
    return df.where(F.col("dt") == bizdate)


def to_dwd(
    ods: DataFrame,
    keys: Sequence[str],
    order_column: str,
    types: Mapping[str, str] | None = None,
    defaults: Mapping[str, object] | None = None,
) -> DataFrame:
    """Latest row per key and date, with standard types and defaults for missing values."""
    per_day = [*keys, "dt"] if "dt" not in keys else list(keys)
    ties = [c for c in ods.columns if c not in per_day and c not in (order_column, "etl_time")]
    latest = keep_latest(ods, per_day, order_column, ties)
    typed = standardise_types(latest, types) if types else latest
    return fill_defaults(typed, defaults) if defaults else typed


def to_dws(dwd: DataFrame, dimensions: Sequence[str], metrics: Sequence[Column]) -> DataFrame:
    """Rollup per date; ``dt`` is part of the grain, so one call may cover many dates."""
    return dwd.groupBy(*dimensions, "dt").agg(*metrics)


def to_ads(dws: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    return dws.select(*columns, "dt")


@dataclass(frozen=True)
class LayerPlan:
    """What one subject area needs to run through all four layers."""

    keys: tuple[str, ...]
    order_column: str
    dimensions: tuple[str, ...]
    metrics: tuple[Column, ...]
    report: tuple[str | Column, ...]
    types: Mapping[str, str] = field(default_factory=dict)
    defaults: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Layers:
    ods: DataFrame
    dwd: DataFrame
    dws: DataFrame
    ads: DataFrame


def chain(source: DataFrame, plan: LayerPlan, etl_time: str, bizdate: str | Column) -> Layers:
    """All four layers as lazy frames over a source slice of one date, or of many.

    With a column as ``bizdate`` the slice may span a date range: a backfill is one job whose
    rows carry their own date, not a loop of daily jobs.
    """
    ods = to_ods(source, etl_time, bizdate)
    dwd = to_dwd(ods, plan.keys, plan.order_column, plan.types, plan.defaults)
    dws = to_dws(dwd, plan.dimensions, plan.metrics)
    return Layers(ods, dwd, dws, to_ads(dws, plan.report))


LAYER_NAMES = ("ODS", "DWD", "DWS", "ADS")
LEDGER = "run string, layer string, first string, last string, etl_time string"


def _write_dates(rows: DataFrame, layer: str, path: str, first: str, last: str) -> None:
    """Replace the partitions of all dates from ``first`` to ``last``; dates without rows end up absent.

    Rows go in by dynamic overwrite. A folder of the range that holds the same files after the write as before was not written, so
    its rows are from an earlier run and it goes. That is read from the listing alone, with the names that Spark gives the folders.
    """
    from lakestrata.sources.write import LAYER_STORAGE

    spark = rows.sparkSession
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName

    def held() -> dict[str, set[str]]:
        folders = (name for name in list_names(spark, path) if name.startswith("dt="))
        return {f: list_names(spark, f"{path}/{f}") for f in folders if first <= unescape(f[3:]) <= last}

    before = held()
    storage = LAYER_STORAGE[layer]
    writer = rows.write.format(storage.file_format).option("compression", storage.compression).mode("overwrite")
    writer.partitionBy("dt").option("partitionOverwriteMode", "dynamic").save(path)
    after = held()
    for folder, files in before.items():
        if after.get(folder) == files:
            delete_path(spark, f"{path}/{folder}")


def run_dates(
    source: DataFrame, plan: LayerPlan, etl_time: str, first: str, last: str, folder: str, run: str | None = None
) -> dict[str, str]:
    """Write all four layers for the dates from ``first`` to ``last``; each layer reads back the layer below. Returns the layer paths.

    ``source`` has its date as ``dt``. With a ``run`` name, finished layers are noted in a ledger beside the data, and a repeat of the
    same run does only what is missing: after a failure it goes on at the layer that failed, after success it writes nothing.
    """
    from lakestrata.sources.write import LAYER_STORAGE

    paths = {layer: f"{folder}/{layer.lower()}" for layer in LAYER_NAMES}
    spark = source.sparkSession
    ledger = f"{folder}/_ledger"
    done = set()
    if run is not None:
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
        done = {r["layer"] for r in spark.read.schema(LEDGER).parquet(ledger).where(F.col("run") == run).collect()}

    def stored(layer: str, like: DataFrame) -> DataFrame:
        reader = spark.read.format(LAYER_STORAGE[layer].file_format).schema(like.schema)
        return reader.load(paths[layer]).where(F.col("dt").between(first, last))

    raw = to_ods(source, etl_time, F.col("dt"))
    steps = {
        "ODS": lambda: raw,
        "DWD": lambda: to_dwd(stored("ODS", raw), plan.keys, plan.order_column, plan.types, plan.defaults),
        "DWS": lambda: to_dws(stored("DWD", steps["DWD"]()), plan.dimensions, plan.metrics),
        "ADS": lambda: to_ads(stored("DWS", steps["DWS"]()), plan.report),
    }
    for layer, rows in steps.items():
        if layer in done:
            continue
        _write_dates(rows(), layer, paths[layer], first, last)
        if run is not None:
            spark.createDataFrame([(run, layer, first, last, etl_time)], LEDGER).write.mode("append").parquet(ledger)
    return paths


def run_day(source: DataFrame, plan: LayerPlan, etl_time: str, bizdate: str, folder: str, run: str | None = None) -> dict[str, str]:
    """Run one date and write every layer; see ``run_dates``."""
    return run_dates(source.withColumn("dt", F.lit(bizdate)), plan, etl_time, bizdate, bizdate, folder, run)


def _range_of(source: DataFrame, date_column: str, first: str, last: str) -> DataFrame:
    """The rows of a range of dates, by a comparison on the raw column, so the scan skips what lies outside."""
    day = F.col(date_column)
    start = F.to_timestamp_ntz(F.lit(first))
    end = F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz")
    return source.where((day >= start) & (day < end))


def run_backfill(
    source: DataFrame, plan: LayerPlan, etl_time: str, date_column: str, first: str, last: str, folder: str, run: str | None = None
) -> dict[str, str]:
    """Write every layer for every date from ``first`` to ``last`` inclusive, each layer as one job; see ``run_dates``."""
    dated = _range_of(source, date_column, first, last).withColumn("dt", F.date_format(date_column, "yyyy-MM-dd"))
    return run_dates(dated, plan, etl_time, first, last, folder, run)


def backfill(source: DataFrame, plan: LayerPlan, etl_time: str, date_column: str, first: str, last: str) -> Layers:
    """The chain over every date from ``first`` to ``last`` inclusive, as one job that writes nothing."""
    return chain(_range_of(source, date_column, first, last), plan, etl_time, F.date_format(date_column, "yyyy-MM-dd"))
