"""Nearest neighbours by inner product, from balanced posting lists.

A bounded sample is split in halves again and again, which gives lists of equal shares and their centroids. A
graph of neighbouring centroids is small enough for every task's memory, and a best-first search on it finds
the lists of a vector. Vectors near a border stand in several lists. A query reads those lists
whose centroid is at most ``ratio`` times as far as the nearest; the ratio is the least that finds
``AIM`` of the true neighbours of sampled queries. Lists longer than ``LIST`` are read in parts.

One more component makes all vectors equally long, so that the nearest are those of the largest product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestrata.llm.shared import per_batch
from lakestrata.llm.vectors import matrix, usable, usual_width
from lakestrata.session import materialize

SAMPLE = 32_768  # vectors that the lists are fitted on
PER_LIST, MOST_LISTS = 256, 1_024  # sampled vectors behind a centroid; centroids at most
TRIALS = 256  # sampled queries that the ratio is chosen with
AIM = 0.97
COPIES, BORDER = 4, 1.06  # lists of a vector at most, and how much farther the others may be
DEGREE = 24  # neighbours of a centroid in the graph
LEAST_LISTS = 8  # lists that a query reads in any case: a tight cluster may fill a list by itself
LIST = 2_000  # vectors of a list that are read together


def lengthened(rows: np.ndarray, longest: float) -> np.ndarray:
    """Rows with one more component, all of length ``longest``."""
    rest = np.sqrt(np.maximum(longest * longest - (rows * rows).sum(1, keepdims=True), 0))
    return np.concatenate([rows, rest], 1)


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((rows * rows).sum(1)[:, None] + (points * points).sum(1)[None] - 2 * rows @ points.T, 0))


def halves(rows: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of ``lists`` (a power of two) equal shares: each split is at the median along the line between two means."""
    parts = [rows]
    while len(parts) < lists:
        split = []
        for part in parts:
            middle = part.mean(0)
            far = part[np.argmax(((part - middle) ** 2).sum(1))]
            a, b = far, 2 * middle - far
            for _ in range(6):
                along = part @ (a - b)
                order = np.argsort(along, kind="stable")
                low, high = part[order[: len(part) // 2]], part[order[len(part) // 2 :]]
                a, b = high.mean(0), low.mean(0)
            split += [low, high]
        parts = split
    return np.array([p.mean(0) for p in parts])


class Index(NamedTuple):
    centroids: np.ndarray
    graph: np.ndarray  # (centroids, DEGREE): neighbours, nearest first
    longest: float
    ratio: float
    beam: int  # lists that a query looks at

    def search(self, rows: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest ``beam`` centroids of each row and their distances, by best-first search on the graph."""
        parts = [self._search(rows[at : at + 1024], beam) for at in range(0, len(rows), 1024)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, rows: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows step together: the neighbours of the best so far join them, until nothing better turns up."""
        n, beam = len(self.centroids), min(beam, len(self.centroids))
        norms = (self.centroids**2).sum(1)
        spread = np.linspace(0, n - 1, min(n, max(beam, 16))).astype(int)
        held = np.tile(spread, (len(rows), 1))
        far = norms[held] - 2 * np.einsum("qd,qkd->qk", rows, self.centroids[held])
        expanded = np.zeros((len(rows), n), bool)
        known = np.zeros((len(rows), n), bool)
        np.put_along_axis(known, held, True, 1)
        at = np.arange(len(rows))
        while True:
            order = np.argsort(far, axis=1, kind="stable")[:, : max(beam, 16)]
            held, far = np.take_along_axis(held, order, 1), np.take_along_axis(far, order, 1)
            fresh = ~np.take_along_axis(expanded, held, 1) & np.isfinite(far)
            if not fresh.any():
                break
            # Each row opens its best centroid that is not open yet; rows that are done open theirs again.
            pick = held[at, fresh.argmax(1)]
            expanded[at, pick] = True
            near = self.graph[pick]
            new = ~np.take_along_axis(known, near, 1)
            np.put_along_axis(known, near, True, 1)
            more = np.where(new, norms[near] - 2 * np.einsum("qd,qkd->qk", rows, self.centroids[near]), np.inf)
            held, far = np.concatenate([held, near], 1), np.concatenate([far, more], 1)
            # A neighbour known before is held already, or was worse than all that are.
        return held[:, :beam], np.sqrt(np.maximum(far[:, :beam] + (rows * rows).sum(1)[:, None], 0))


def build(rows: np.ndarray, longest: float, top: int) -> Index:
    """Fit on a sample (original vectors); choose the ratio by brute force over the same sample."""
    points = lengthened(rows, longest)
    lists = 1 << max(0, int(math.log2(max(1, min(MOST_LISTS, len(rows) // PER_LIST)))))
    centroids = halves(points, lists)
    between = distances(centroids, centroids)
    graph = np.argsort(between, axis=1, kind="stable")[:, 1 : DEGREE + 1] if lists > 1 else np.zeros((1, 1), int)
    # A ring through all centroids keeps the graph connected.
    graph = np.concatenate([graph, np.roll(np.arange(lists), 1)[:, None]], 1)
    index = Index(centroids, graph, longest, math.inf, lists)
    if lists == 1:
        return index
    homes, home_far = index.search(points, COPIES)
    homes = np.where(home_far <= BORDER * home_far[:, :1], homes, -1)
    at = np.linspace(0, len(rows) - 1, min(TRIALS, len(rows))).astype(int)
    scores = rows[at] @ rows.T
    scores[np.arange(len(at)), at] = -np.inf
    true = np.argsort(-scores, axis=1, kind="stable")[:, :top]
    query = lengthened(rows[at], longest)
    query[:, -1] = 0
    far = distances(query, centroids)
    relative = far / np.maximum(far.min(1, keepdims=True), 1e-12)
    # The ratio at which a true neighbour turns up is that of the nearest of its lists.
    needed = np.where(homes[true] >= 0, np.take_along_axis(np.repeat(relative[:, None], true.shape[1], 1), np.maximum(homes[true], 0), 2), np.inf).min(2)
    ratio = float(np.quantile(needed, AIM, method="higher"))
    beam = int(min(lists, (relative <= ratio).sum(1).max() + 8))
    return index._replace(ratio=ratio, beam=beam)


def nearest(vectors: DataFrame, queries: Column, top: int) -> DataFrame:
    """query_id, rank, vec_id and score of the ``top`` nearest found for each row that ``queries`` selects.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those with a null
    vec_id or of another length than most. Repeated rows count once, of rows that share a vec_id the one with the
    smallest components does, and a row is no neighbour of its own vec_id. Ties go to the smaller vec_id. Other columns are ignored.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    width = usual_width(rows, "v")
    rows = rows.where(F.size("v") == width).groupBy("vec_id").agg(F.min("v").alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    longest = math.sqrt(rows.agg(F.max(squares)).first()[0] or 0.0)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("v")
    sample = matrix(picked.toArrow()["v"])
    kind = "list int, place int, id long, v array<double>"
    if not len(sample):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    index = build(sample, longest, top)

    def listed(query: bool):
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = matrix(batch["v"])
            points = lengthened(own, index.longest)
            if query:
                points[:, -1] = 0
            found, far = index.search(points, index.beam if query else COPIES)
            keep = far <= (index.ratio if query else BORDER) * far[:, :1]
            if query:
                keep[:, :LEAST_LISTS] = True
            i, k = np.nonzero(keep)
            taken = pa.array(i)
            columns = [pa.array(found[i, k], pa.int32()), pa.array(np.full(len(i), int(query)), pa.int32()), batch["vec_id"].take(taken), batch["v"].take(taken)]
            return pa.RecordBatch.from_arrays(columns, ["list", "place", "id", "v"])

        return step

    entries = materialize(per_batch(rows, lambda: listed(False), kind), "postings")
    asked = per_batch(rows.where(queries), lambda: listed(True), kind)
    parts = entries.groupBy("list").agg(F.ceil(F.count("*") / LIST).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    # A query visits every part of its lists.
    part = F.when(F.col("place") == 0, F.array(part)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    both = entries.unionByName(asked).join(parts, "list").select("list", F.explode(part).alias("part"), "place", "id", "v")
    dealt = both.repartition("list", "part").sortWithinPartitions("list", "part", "place", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors of a part come first and are held; its queries are then answered as they come."""

        def answer(table: pa.Table, ids: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
            who, q = table["id"].to_numpy(), matrix(table["v"])
            scores = q @ held.T
            scores[who[:, None] == ids[None]] = -np.inf
            many = min(top + 4, len(ids))  # some more, for the last digits of a product of matrices
            best = np.argpartition(-scores, many - 1, axis=1)[:, :many] if many < len(ids) else np.tile(np.arange(len(ids)), (len(q), 1))
            lists = []
            for i in range(len(q)):
                # Equal scores at the edge: all of them are looked at.
                j = best[i] if many == len(ids) else np.flatnonzero(scores[i] >= scores[i, best[i]].min())
                j = j[scores[i, j] > -np.inf]
                # Rounded once, so that a vector has one score in all of its lists.
                one = q[i].tolist()
                exact = np.array([math.sumprod(one, v) for v in held[j].tolist()])
                order = np.lexsort((ids[j], -exact))[:top]
                lists.append([{"score": s, "vec_id": k} for s, k in zip(exact[order].tolist(), ids[j][order].tolist())])
            kind = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array(who), pa.array(lists, kind)], ["query_id", "found"])

        key, ids, vs = None, [], []
        for batch in batches:
            lists, part, place = (batch[c].to_numpy() for c in ("list", "part", "place"))
            code = (lists.astype(np.int64) << 32) + part * 2 + place
            start = 0
            for stop in [*(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]:
                piece = pa.Table.from_batches([batch.slice(start, stop - start)])
                if (lists[start], part[start]) != key:
                    key, ids, vs = (lists[start], part[start]), [], []
                if not place[start]:
                    ids.append(piece["id"].to_numpy())
                    vs.append(matrix(piece["v"]))
                elif ids:
                    ids, vs = [np.concatenate(ids)], [np.concatenate(vs)]
                    for at in range(0, len(piece), 512):
                        yield answer(piece.slice(at, 512), ids[0], vs[0])
                start = stop

    found = dealt.mapInArrow(run, "query_id long, found array<struct<score:double,vec_id:long>>")
    order = lambda x: F.struct((-x["score"]).alias("low"), x["vec_id"].alias("vec_id"))
    merged = found.groupBy("query_id").agg(F.flatten(F.collect_list("found")).alias("found"))
    # A vector is in COPIES lists at most, so the best of all are among so many entries.
    ranked = F.slice(F.array_distinct(F.slice(F.array_sort(F.transform("found", order)), 1, top * COPIES)), 1, top)
    rows = merged.select("query_id", F.posexplode(ranked).alias("place", "x"))
    return rows.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.low")).alias("score"))
