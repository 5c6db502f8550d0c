"""Streaming jobs over the event files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakestrata.functions import numeric as N
from lakestrata.session import scratch_path
from lakestrata.streaming import jobs as S
from lakestrata.workload import query


def _events(t):
    return S.file_stream(t.spark, t.folder, t.events.schema, "events.parquet")


@query(
    "stream_ingest",
    "X1 S4",
    """
    SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d') AS dt, '2024-02-01 02:00:00' AS etl_time FROM events
    """,
)
def stream_ingest(t):
    path, checkpoint = scratch_path(t.spark, "ingest"), scratch_path(t.spark, "ingest-checkpoint")
    S.ingest(_events(t), path, checkpoint, "2024-02-01 02:00:00", "ts")
    stored = t.spark.read.schema("event_id bigint, user_id bigint, event_type string, etl_time timestamp_ntz, dt string").parquet(path)
    return stored.withColumn("etl_time", F.date_format("etl_time", "yyyy-MM-dd HH:mm:ss"))


@query("stream_dedup", "X2", "SELECT event_id, event_type FROM events")
def stream_dedup(t):
    path, checkpoint = scratch_path(t.spark, "dedup"), scratch_path(t.spark, "dedup-checkpoint")
    twice = _events(t).unionByName(_events(t)).select("event_id", "event_type", "ts")
    S.append_to(S.deduplicate(twice, ["event_id"], "ts", "1 hour").select("event_id", "event_type"), path, checkpoint)
    return t.spark.read.schema("event_id bigint, event_type string").parquet(path)


@query(
    "stream_upsert",
    "X3 S16",
    """
    SELECT user_id, dt, event_id, event_type FROM (
      SELECT *, strftime(ts, '%Y-%m-%d') AS dt, ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id) AS rn FROM events)
    WHERE rn = 1
    """,
)
def stream_upsert(t):
    path, checkpoint = scratch_path(t.spark, "upsert"), scratch_path(t.spark, "upsert-checkpoint")
    rows = _events(t).select("user_id", "ts", "event_id", "event_type", N.day_key("ts").alias("dt"))
    for name in (checkpoint, f"{checkpoint}-replay"):  # all files once more, as after a lost checkpoint
        S.upsert_into(rows, path, name, ["user_id", "dt"], "dt", "ts")
    return t.spark.read.schema("user_id bigint, event_id bigint, event_type string, dt string").parquet(path)


@query(
    "stream_hourly_rollup",
    "X4",
    """
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, COUNT(*) AS n,
           CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM events GROUP BY date_trunc('hour', ts), event_type
    HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE
    """,
)
def stream_hourly_rollup(t):
    path, checkpoint = scratch_path(t.spark, "rollup"), scratch_path(t.spark, "rollup-checkpoint")
    metrics = [F.count("*").alias("n"), F.sum(N.money("value")).cast("double").alias("total")]
    S.append_to(S.rollup(_events(t), "ts", "1 hour", ["event_type"], metrics, "10 minutes"), path, checkpoint)
    kind = "window_start timestamp_ntz, event_type string, n bigint, total double"
    stored = t.spark.read.schema(kind).parquet(path)
    return stored.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
