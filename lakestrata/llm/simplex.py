"""Exact integer k-means whose centroids are filtered by N-simplex projection.

Some vectors serve as pivots. Their distances to each other give a simplex, and the distances of any vector to
them give the one point, its apex, that stands over this base: coordinates within the base and an altitude
above it. For two apexes over the same base, the distance of the points is a lower bound of the true one, and
the distance with one altitude turned below the base is an upper bound. A vector's distances to the pivots, and so its apex,
never change: they are computed once and kept beside it. In each round the apexes of the centroids bound all
distances; a centroid whose lower bound exceeds the least upper bound cannot be the nearest, and only the others are
compared exactly, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestrata.llm.shared import per_batch
from lakestrata.llm.vectors import matrix
from lakestrata.session import materialize

SCALE = 64
WIDTH = 64
LARGEST = 1 << 27  # components below it keep a squared distance of 64 components within a long
FLAT = 0.01  # a pivot whose altitude over those before it is less, as a share of the base's extent, adds nothing
CHUNK = 2_000  # vectors that are compared at a time


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` to the rows of ``b``."""
    return np.stack([((a - row) ** 2).sum(1) for row in b], 1) if len(b) else np.zeros((len(a), 0), np.int64)


class Simplex:
    """The base simplex of some pivots, vertex by vertex: each pivot is the apex over those before it."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.base = pivots[:1], np.zeros((0, 0))  # vertices after the first, a lower triangle
        for i in range(1, len(pivots)):
            extent = np.sqrt(squares(pivots[: i + 1], pivots[:1]).max())
            apex = self.apexes(pivots[i : i + 1])[0]
            if apex[-1] > FLAT * extent:
                n = len(self.base)
                self.base = np.block([[self.base, np.zeros((n, 1))], [apex[None]]]) if n else apex[None]
                self.pivots = np.concatenate([self.pivots, pivots[i : i + 1]])
        self.inverse = np.linalg.inv(self.base) if len(self.base) else self.base

    def apexes(self, rows: np.ndarray) -> np.ndarray:
        """Coordinates within the base and, last, the altitude of each row, from its distances to the pivots alone."""
        far = squares(rows, self.pivots).astype(float)
        sides = (self.base**2).sum(1)
        within = ((far[:, :1] + sides - far[:, 1:]) / 2) @ np.linalg.inv(self.base).T if len(self.base) else np.zeros((len(rows), 0))
        altitude = np.sqrt(np.maximum(far[:, 0] - (within**2).sum(1), 0))
        return np.concatenate([within, altitude[:, None]], 1)

    def slack(self, size: np.ndarray) -> np.ndarray:
        """What rounding may add to a bound of two apexes whose distances to the first pivot are ``size`` at most."""
        size = np.maximum(size, np.sqrt((self.base**2).sum(1).max(initial=0)))
        unit = 2.0**-50 * (len(self.base) + 1)
        shift = unit * size * (1 + np.linalg.norm(self.inverse) * size + (np.linalg.cond(self.base) if len(self.base) else 0))
        return 8 * (shift + np.sqrt(2 * size * shift + unit * size**2))


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distances that the apexes ``a`` and ``b`` allow, before rounding."""
    within = np.stack([((a[:, :-1] - row[:-1]) ** 2).sum(1) for row in b], 1)
    low = np.sqrt(within + (a[:, -1:] - b[:, -1]) ** 2)
    high = np.sqrt(within + (a[:, -1:] + b[:, -1]) ** 2)
    return low, high


class Space(NamedTuple):
    """Centroids with their apexes over one base."""

    simplex: Simplex
    centroids: np.ndarray
    apexes: np.ndarray

    @classmethod
    def of(cls, simplex: Simplex, centroids: np.ndarray) -> Space:
        return cls(simplex, centroids, simplex.apexes(centroids))

    def nearest(self, rows: np.ndarray, apexes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row the nearest centroid (the first of equals), the squared distance, and how many were compared exactly."""
        parts = [self._nearest(rows[i : i + CHUNK], apexes[i : i + CHUNK]) for i in range(0, len(rows), CHUNK)]
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _nearest(self, rows, apexes):
        low, high = bounds(apexes, self.apexes)
        size = np.maximum(np.linalg.norm(apexes, axis=1), np.linalg.norm(self.apexes, axis=1).max())
        slack = self.simplex.slack(size)
        row, centroid = np.nonzero(low <= (high.min(1) + 2 * slack)[:, None])
        found = np.full(low.shape, np.iinfo(np.int64).max)
        found[row, centroid] = ((rows[row] - self.centroids[centroid]) ** 2).sum(1)
        best = found.argmin(1)
        return best, found[np.arange(len(rows)), best], np.bincount(row, minlength=len(rows))


def whole(vector: Column, width: int = WIDTH) -> Column:
    """Whether a vector takes part: so many components, none of them null, non-finite or too large for exact distances."""
    fits = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) * SCALE < LARGEST - 1, F.lit(False)))
    return F.coalesce((F.size(vector) == width) & fits, F.lit(False))


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))


def place(vectors: DataFrame, simplex: Simplex) -> DataFrame:
    """vec_id, q and apex of rows of vec_id and q, written once: what every round reads."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            apexes = simplex.apexes(matrix(batch["q"]).astype(np.int64))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(apexes.ravel()), apexes.shape[1]).cast(pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([batch["vec_id"], batch["q"], lists], ["vec_id", "q", "apex"])

        return step

    return materialize(per_batch(vectors, make, "vec_id long, q array<int>, apex array<double>"), "apexes")


def moved(placed: DataFrame, space: Space) -> np.ndarray:
    """The centroids after one round: floors of the exact means of their vectors; those without vectors stay.

    Every task adds up its own vectors, so it hands on one row of sums a centroid.
    """
    k, width = space.centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch["q"]).astype(np.int64)
            cluster = space.nearest(rows, matrix(batch["apex"]))[0]
            counts += np.bincount(cluster, minlength=k)
            for j in np.unique(cluster):
                sums[j] += rows[cluster == j].sum(0)
        used = np.flatnonzero(counts)
        lists = pa.array(list(sums[used]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), lists], ["cluster", "n", "sums"])

    total = lambda c: F.sum(c.cast("decimal(38,0)"))
    parts = placed.select("q", "apex").mapInArrow(add, "cluster int, n long, sums array<long>").groupBy("cluster")
    found = parts.agg(total(F.col("n")).alias("n"), F.array(*(total(F.col("sums")[i]) for i in range(width))).alias("sums")).collect()
    out = space.centroids.copy()
    for r in found:
        out[r["cluster"]] = [int(s) // int(r["n"]) for s in r["sums"]]
    return out


def cluster(vectors: DataFrame, centroids: int = 16, rounds: int = 3, salt: str = "1", width: int = WIDTH) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and n_compared of every vector that takes part.

    Components become floor(64 * x). The centroids begin as the vectors with the smallest SHA-256 of salt and id, which serve as
    pivots, too. A vector that is null, has another number of components, or a component that is null, not finite or
    2**21 or more in size (its squared distances would not fit a long) takes no part and is not returned. Repeated rows each count;
    of rows that share a vec_id the smaller vector comes first where centroids are picked. A null vec_id is never picked but
    takes part otherwise. With fewer vectors than centroids each begins as one; no vectors give no rows. Equal
    distances go to the smaller number. Sums that exceed a long come out null. Other columns are ignored.
    """
    rows = vectors.where(whole(F.col("embedding"), width)).select(F.col("vec_id").cast("long"), integers(F.col("embedding")).alias("q"))
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    picked = rows.where("vec_id is not null").orderBy(order, "q").limit(centroids).collect()
    if not picked:  # without an id that could be picked there is no centroid
        kind = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_compared int".split(", ")
        return rows.limit(0).select("vec_id", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in kind))
    start = np.array([r["q"] for r in picked], np.int64)
    simplex = Simplex(start)
    placed = place(rows, simplex)
    space = Space.of(simplex, start)
    for _ in range(rounds):
        space = Space.of(simplex, moved(placed, space))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            best, distance, compared = space.nearest(matrix(batch["q"]).astype(np.int64), matrix(batch["apex"]))
            columns = [batch["vec_id"], pa.array(best, pa.int32()), pa.array(distance, pa.int64()), pa.array(compared, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "n_compared"])

        return step

    out = materialize(per_batch(placed, make, "vec_id long, cluster int, distance long, n_compared int"), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None

    def of_cluster(values: dict, kind: str) -> Column:
        return F.element_at(F.create_map(*(F.lit(x).cast(t) for k, v in values.items() for x, t in ((k, "int"), (v, kind)))), F.col("cluster"))

    names = {k: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for k, c in enumerate(space.centroids.tolist())}
    return out.select(
        "vec_id", "cluster", "distance",
        of_cluster({k: fits(s) for k, s in sums.items()}, "long").alias("cluster_inertia"),
        F.lit(fits(sum(sums.values()))).cast("long").alias("inertia"),
        of_cluster(names, "string").alias("centroid_sha256"),
        "n_compared",
    )
