"""Near-duplicate vectors by a pivot-permutation index.

Vectors are described by their nearest reference points, the pivots, in order. Vectors that are near each
other rank much the same pivots first, so a list of vectors for each pivot brings them together. Two
that share enough pivots are candidates, in the list of the first pivot they share only, and their cosine is
then computed. Equal vectors are one entry with a count. Tasks return a count of links for each vector
and edges that span what they linked, never the links themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestrata.llm.shared import components, per_batch
from lakestrata.llm.vectors import matrix, per_group, usable
from lakestrata.session import materialize

NEAREST = 10  # pivots in a description
SHARED = 3  # pivots that candidates have in common
LEAST_PIVOTS, MOST_PIVOTS = 64, 2048
BLOCK = 1_000  # members of a list in one task, twice


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def describe(rows: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """The nearest pivots of each row, nearest first; ties to the smaller number."""
    return np.argsort(-(unit(rows) @ pivots.T), axis=1, kind="stable")[:, :nearest].astype(np.int32)


def bitmaps(ranked: np.ndarray, pivots: int) -> np.ndarray:
    bits = np.zeros((len(ranked), -(-pivots // 64) * 64), np.uint8)
    np.put_along_axis(bits, ranked, 1, axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def links(a: np.ndarray, b: np.ndarray, seen_a: np.ndarray, seen_b: np.ndarray, pivot: int, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of linked rows whose first shared pivot is ``pivot``."""
    left, right = [], []
    word, bit = pivot // 64, np.uint64(pivot % 64)
    below = (np.uint64(1) << bit) - np.uint64(1)
    for at in range(0, len(a), 256):
        part = seen_a[at : at + 256]
        common = np.zeros((len(part), len(b)), np.uint8)
        earlier = np.zeros((len(part), len(b)), bool)
        for w in range(seen_b.shape[1]):
            both = part[:, w, None] & seen_b[None, :, w]
            common += np.bitwise_count(both)
            if w < word:
                earlier |= both != 0
            elif w == word:
                earlier |= (both & below) != 0
        i, j = np.nonzero((common >= SHARED) & ~earlier)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        near = (a[i] * b[j]).sum(1) >= least
        left.append(i[near])
        right.append(j[near])
    return np.concatenate(left), np.concatenate(right)


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest place that each place reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(vectors: DataFrame, least: float) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; links are between rows of equal labels with cosine >= ``least``.

    Rows with a null label, or a vector that is null, zero, or has null or non-finite components, have no links; so
    have rows with a null vec_id, which are kept, and vectors of other lengths have none with each other.
    Repeated rows are one vector. Other columns are ignored, and no rows give none.
    """
    given = vectors.select("vec_id", "embedding", "label")
    takes_part = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    valid = given.where(takes_part).distinct()
    kinds = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    kinds = materialize(kinds.withColumn("width", F.size("embedding")), "vectors")
    size, width = kinds.agg(F.count("*"), F.max("width")).first()
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, round(2 * math.sqrt(size))))
    picked = kinds.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).select("embedding").collect()
    width = width or 1
    pad = lambda v: [*v, *[0.0] * (width - len(v))]
    pivots = unit(np.array([pad(r["embedding"]) for r in picked], float).reshape(-1, width))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = np.array([pad(v) for v in batch["embedding"].to_pylist()], float)
            ranked = describe(rows, pivots)
            described = pa.array(list(ranked), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([batch["vec_id"], batch["n"], batch["label"].cast(pa.int64()), batch["width"], described, pa.array(list(rows), pa.list_(pa.float64()))], ["vec_id", "n", "label", "width", "ranked", "v"])

        return step

    kind = "vec_id long, n long, label long, width int, ranked array<int>, v array<double>"
    index = per_batch(kinds.select("vec_id", "n", "label", "width", "embedding"), make, kind)
    index = materialize(index, "index")
    listed = index.withColumn("pivot", F.explode("ranked"))
    lists = ["label", "width", "pivot"]
    blocks = listed.groupBy(*lists).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("size")).where("size > 1").drop("size")
    own = listed.join(blocks, lists).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    # Each block meets itself and every other block of its list once.
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = [*lists, "x", "y"]
    met = met.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("blocks", "other")
    dealt = met.repartition(*keys).sortWithinPartitions(*keys, "block", "vec_id")
    n_pivots = len(pivots)

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        block, x, y = rows["block"].to_numpy(), rows["x"][0].as_py(), rows["y"][0].as_py()
        ids, weight = rows["vec_id"].to_numpy(), rows["n"].to_numpy()
        v, seen = unit(matrix(rows["v"])), bitmaps(matrix(rows["ranked"]).astype(np.int64), n_pivots)
        first = block == x
        second = first if x == y else ~first
        i, j = links(v[first], v[second], seen[first], seen[second], rows["pivot"][0].as_py(), least, x == y)
        if not len(i):
            return
        i, j = np.flatnonzero(first)[i], np.flatnonzero(second)[j]
        count = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
        root = roots(len(ids), i, j)
        has = count > 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(ids[root[has]]), pa.array(count[has].astype(np.int64))], ["u", "v", "n"])

    found = materialize(per_group(dealt, keys, run, "u long, v long, n long"), "linked")
    counts = found.groupBy("u").agg(F.sum("n").alias("links")).withColumnRenamed("u", "vec_id")
    joined = components(found.select("u", "v")).withColumnRenamed("node", "vec_id")
    named = kinds.join(counts, "vec_id", "left").join(joined, "vec_id", "left")
    links_of = F.coalesce("links", F.lit(0)) + F.col("n") - 1
    named = materialize(named.select("label", "embedding", links_of.alias("n_links"), F.coalesce("component", "vec_id").alias("component")), "named")
    rows = given.select("vec_id", F.when(takes_part, F.col("label")).alias("label"), F.when(takes_part, F.col("embedding")).alias("embedding"))
    out = rows.join(named, ["label", "embedding"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
