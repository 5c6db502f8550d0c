"""Small helpers of the operators in this subpackage: Arrow columns, whole-text rows, components of a graph."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestrata.session import materialize


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes, one entry per row."""
    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def per_batch(rows: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Map every Arrow batch by a function that ``make`` builds once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return rows.mapInArrow(run, schema)


def per_process(key: tuple, make: Callable):
    """What ``make`` returns, made once per Python worker and kept for its later tasks.

    For objects that take long to load and hold nothing but what can be computed again. Functions reach
    the workers by value, with globals of their own in each task, so the keeper is a module by name.
    """
    kept = vars(sys.modules.setdefault("_lakestrata_kept", ModuleType("_lakestrata_kept"))).setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


class Memo(dict):
    """A dictionary that computes what it lacks and holds about ``limit`` entries.

    When it is half full it becomes the older half, and what is asked for again comes back from there, so
    frequent keys stay. It saves work only: an entry that was dropped is computed again with the same result.
    """

    def __init__(self, compute: Callable, limit: int = 400_000):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if 2 * len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


PIECE = 1 << 20
_BREAK = re.compile(rb"[\x20\x09-\x0d]")
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR = mix(np.arange(1, 1 << 12, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, in order: sums of a number for each byte times one for its place in the word.

    Array operations on some bytes at a time, cut where a word ends; nothing is kept.
    """
    found, begin = [], 0
    while begin < len(data):
        cut = _BREAK.search(data, begin + PIECE) if len(data) - begin > PIECE else None
        end = cut.end() if cut else len(data)
        found.append(_hash_words(data[begin:end]))
        begin = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _hash_words(data: bytes) -> np.ndarray:
    codes = np.frombuffer(data, np.uint8)
    letters = np.flatnonzero(~_BLANK[codes])
    if not len(letters):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.diff(letters, prepend=-2) > 1)
    sizes = np.diff(first, append=len(letters))
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    factor = _FACTOR if sizes.max() <= len(_FACTOR) else mix(np.arange(1, sizes.max() + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    return mix(np.add.reduceat(_VALUE[codes[letters]] * factor[place], first) + sizes.astype(np.uint64))


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of ``edges`` (u, v: two nodes of a link) can reach, as (node, component).

    Large-star and small-star steps in turn, each over the whole edge list, until all edges form stars. A
    minimum per node is combined before it is shuffled, and the join that brings it back can be split
    when one node has a large share of all links. Each round is written to the shared scratch
    folder, so a lost executor costs that round at most. Nodes without a link to another node are not listed.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        # Every node to the smallest of its neighbourhood, for the larger neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where("v > u and v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        # Every node and its smaller neighbours to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        joined = large.join(least, "u")
        small = joined.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select("u", F.col("low").alias("v")))
        edges = materialize(small.distinct(), "edges")
        # Stars: every node has one edge down, to a node that has none. Each is then a whole component.
        down = edges.select(F.col("u").alias("node"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v"))
        up = edges.select(F.col("v").alias("node"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v"))
        seen = down.unionByName(up).groupBy("node").agg(F.sum("as_u").alias("as_u"), F.sum("as_v").alias("as_v"))
        if seen.where("as_u > 1 or as_u > 0 and as_v > 0").isEmpty():
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
