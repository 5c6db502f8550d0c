"""Run metrics of one step, gathered while the step runs."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lakestrata.session import metric

RUN_SCHEMA = (
    "step string, status string, rows_read bigint, rows_written bigint, started_at timestamp, "
    "seconds double, error string"
)


def run_step(
    step: str, source: DataFrame, transform: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None]
) -> DataFrame:
    """Transform and write, and return one run record.

    Rows are counted by observers inside the write's own job, so nothing is read twice. A failure
    is recorded with its message and not raised.
    """
    read, written = Observation(f"{step}-read"), Observation(f"{step}-written")
    started = datetime.now(timezone.utc)
    clock = time.monotonic()
    status, error, n_read, n_written = "success", None, None, None
    try:
        result = transform(source.observe(read, F.count(F.lit(1)).alias("n")))
        write(result.observe(written, F.count(F.lit(1)).alias("n")))
    except Exception as failure:  # noqa: BLE001 - the record is the report
        status, error = "failed", str(failure)
    else:
        # A step that yields nothing may be pruned with its observers: no metric then means no rows.
        n_read, n_written = (metric(o, "n") for o in (read, written))
    row = (step, status, n_read, n_written, started, time.monotonic() - clock, error)
    return source.sparkSession.createDataFrame([row], RUN_SCHEMA)
