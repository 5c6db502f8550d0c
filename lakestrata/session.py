"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Accept one more exchange when it lets a hot join key be split.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Larger generated methods are not JIT-compiled; beyond this Spark splits the expressions instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "lakestrata", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; keyword options are extra ``spark.*`` settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    A local session without the setting gets a temporary folder, so tests need no set-up.
    On a cluster a machine-local folder would lose data with its executor, so there the
    setting is required.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not context.getCheckpointDir():
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    fallback = tempfile.mkdtemp(prefix="lakestrata-")
    context.setCheckpointDir(fallback)
    return fallback


def deal(df: DataFrame, *columns: str) -> DataFrame:
    """The rows in as many parts as there are shuffle partitions, by these columns.

    Adaptive execution joins small parts up to a compressed size, which of repetitive names is many rows, and an aggregate before
    the exchange holds all that its task has read. Parts of a fixed number stay apart, so an aggregate over them holds its share only.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def metric(seen: Observation, name: str, missing: object = 0) -> object:
    """A finished observation's metric; ``missing`` when Spark pruned the observed rows and has none."""
    try:
        return seen.get.get(name, missing)
    except Py4JJavaError:
        return missing


_made: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared scratch folder."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder on whatever store it is; whether it was there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def list_names(spark: SparkSession, path: str) -> set[str]:
    """Names of what a folder holds, hidden ones left out; none if there is no such folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = (s.getPath().getName() for s in store.listStatus(target)) if store.exists(target) else ()
    return {name for name in found if name[0] not in "._"}


def release_scratch(spark: SparkSession) -> int:
    """Delete what this session wrote to scratch paths; call it once the results are stored."""
    paths, _made[:] = list(_made), []
    return sum(1 for p in paths if delete_path(spark, p))


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at its end what is written to scratch paths within it; nothing that is read later may depend on that."""
    before = len(_made)
    try:
        yield
    finally:
        paths, _made[before:] = _made[before:], []
        for p in paths:
            delete_path(spark, p)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write the frame as Parquet in the scratch folder and read it back.

    Later stages restart from the files, also after executors are lost. Unlike a checkpoint this
    keeps column pruning and pushdown for whoever reads it again, and its size is known to Spark.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
