"""Incremental ingest, deduplication, upsert and rollup of files that keep arriving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from lakestrata.operators.load import upsert_partitions
from lakestrata.plans.layered import to_ods
from lakestrata.session import delete_path, list_names, scratch_scope


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, name_glob: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """New Parquet files of a folder as a stream, with a declared schema."""
    reader = spark.readStream.schema(schema).format("parquet")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def drain(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything that is there and stop; the checkpoint marks where the next run starts."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def with_event_time(stream: DataFrame, column: str, delay: str) -> DataFrame:
    """Set the watermark; zone-less times become timestamps, which watermarks require."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def ingest(stream: DataFrame, path: str, checkpoint: str, etl_time: str, date_column: str) -> None:
    """Append raw rows to the ODS folder, partitioned by the day of ``date_column``; each file counts once."""
    ods = to_ods(stream, etl_time, F.date_format(date_column, "yyyy-MM-dd"))
    drain(ods.writeStream.format("parquet").outputMode("append").partitionBy("dt").option("path", path), checkpoint)


def deduplicate(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """First row per key; a repeat that arrives within ``delay`` is dropped.

    State for a key is released once the watermark passes, so state does not grow for ever. A
    repeat that is later than that is taken for a new row.
    """
    return with_event_time(stream, event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> None:
    drain(stream.writeStream.format("parquet").outputMode("append").option("path", path), checkpoint)


def upsert_into(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], partition: str, order_column: str
) -> None:
    """Keep the newest row per key in a partitioned folder.

    A batch replayed after a failure changes nothing: the number of the last batch that was applied is kept in the
    checkpoint folder, so it is skipped, and if it failed halfway the newest row wins on both sides. What a batch writes to the scratch folder
    goes with it.
    """
    applied = f"{checkpoint.rstrip('/')}/applied"

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = {int(name.removeprefix("batch-")) for name in list_names(spark, applied)}
        if known and batch_id <= max(known):
            return
        with scratch_scope(spark):
            upsert_partitions(batch, path, keys, partition, order_column, newest_wins=True)
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{applied}/batch-{batch_id}")
        mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(mark).close()
        for old in known:
            delete_path(spark, f"{applied}/batch-{old}")

    drain(stream.writeStream.foreachBatch(apply), checkpoint)


def rollup(
    stream: DataFrame, event_time: str, width: str, dims: Sequence[str], metrics: Sequence[Column], delay: str
) -> DataFrame:
    """Tumbling-window rollup. In append mode a window is given out once the watermark passes its end."""
    timed = with_event_time(stream, event_time, delay)
    summary = timed.groupBy(F.window(event_time, width), *dims).agg(*metrics)
    ends = [F.col("window.start").cast("timestamp_ntz").alias("window_start"), F.col("window.end").cast("timestamp_ntz").alias("window_end")]
    return summary.select(*ends, *dims, *[c for c in summary.columns if c != "window" and c not in dims])
