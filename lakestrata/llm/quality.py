"""A quality classifier learned from preferences between documents (Bradley-Terry).

A document has a strength, linear in features of its text; the chance that one document is preferred
to another is the logistic function of the difference of their strengths. The weights minimise the
logistic loss over pairs of a label-1 and a label-0 document, on feature differences. A score
quantile, chosen on documents that the fit has not seen, is the threshold, and the score is the
logistic function of the distance to it, placed so that the threshold scores ``CUT``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestrata.llm.sample import fold, labelled
from lakestrata.llm.shared import per_batch, raw
from lakestrata.session import materialize

CUT = 0.3
BINS = 8
SLACK = 0.01  # balanced accuracy given up to keep more documents
GROUP = 4_096  # rows whose pairs are made together
FRACTION = 1 << 16  # sums are whole numbers of such parts
STEPS, LIMIT = 1_024, 1 << 16  # strengths are counted in such parts of one, and so many of them each way
FOLDS, HELD = 5, 0


def text_features(data: bytes) -> list[float]:
    """Shares of kinds of characters, repetition, and the shape of words and lines, over the whole text."""
    n = max(1, len(data))
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = lambda *codes: float(seen[list(codes)].sum()) / n
    words, lines = data.split(), data.split(b"\n")
    k = max(1, len(words))
    different = len(set(words))
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 0
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    used = seen[seen > 0] / n
    return [
        math.log1p(len(data)),
        math.log1p(len(words)),
        float(seen[65:91].sum()) / n,
        float(seen[97:123].sum()) / n,
        float(seen[48:58].sum()) / n,
        float(seen[128:].sum()) / n,
        share(*b"!?"),
        share(*b"*#$%&@^~=+"),
        share(*b"|<>[]{}()_/\\"),
        share(*b".,;:"),
        share(*b"'\"-"),
        share(10),
        share(32, 9),
        float(-(used * np.log(used)).sum()) if len(data) else 0.0,
        different / k,
        different / math.sqrt(k),
        (pairs + 1) / k,
        float(lengths.mean()),
        float(lengths.std()),
        float(lengths.max()),
        float((lengths == 1).sum()) / k,
        len(set(lines)) / len(lines),
        k / len(lines),
        sum(w[:1].isupper() for w in words) / k,
        sum(w.isupper() for w in words) / k,
        sum(w[-1:] in b".,;:!?" for w in words) / k,
        sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / k,
    ]


class Model(NamedTuple):
    edges: np.ndarray  # (features, BINS - 1): where bins begin
    weights: np.ndarray  # (features * BINS)
    threshold: float
    slope: float

    def strengths(self, rows: np.ndarray) -> np.ndarray:
        return one_hot(rows, self.edges) @ self.weights

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strengths(rows) - self.threshold) + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def one_hot(rows: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Each feature as the bin it falls in, so that a linear strength may bend."""
    out = np.zeros((len(rows), edges.shape[0] * BINS), np.float32)
    for j, cuts in enumerate(edges):
        out[np.arange(len(rows)), j * BINS + np.searchsorted(cuts, rows[:, j], "right")] = 1
    return out


def unscored(n_features: int) -> Model:
    """Without both labels there is no preference, and every document scores 0.5."""
    return Model(np.zeros((n_features, BINS - 1)), np.zeros(n_features * BINS), math.log(CUT / (1 - CUT)), 1.0)


def _sorted_bits(values: np.ndarray) -> np.ndarray:
    """Numbers as 32-bit floats whose bits, read as unsigned integers, are in the order of the numbers."""
    bits = (values.astype(np.float32) + np.float32(0)).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))


def _from_bits(bits: np.ndarray) -> np.ndarray:
    bits = np.asarray(bits, np.uint32)
    return np.where(bits >> 31, bits & np.uint32((1 << 31) - 1), ~bits).astype(np.uint32).view(np.float32).astype(float)


def _sums(rows: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], np.ndarray]]) -> dict[int, int]:
    """Whole numbers that ``make``'s function counts in every batch, summed over all rows; at most as many leave a task as there are places."""

    def run(batches):
        step, total = make(), None
        for batch in batches:
            if batch.num_rows:
                found = step(batch)
                total = found if total is None else total + found
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at].astype(np.int64))], ["at", "n"])

    return {r["at"]: r["n"] for r in rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return batch["f"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def quantile_edges(rows: DataFrame, n_features: int, n: int) -> np.ndarray:
    """The values that ``BINS`` equal shares of all ``n`` rows begin with, for each feature, to 24 bits.

    Two counts over all rows: of the values' upper 16 bits, then of the next 8 of those that share them with an edge.
    """
    ranks = [n * k // BINS for k in range(1, BINS)]

    def upper():
        return lambda batch: _counted(_sorted_bits(_features(batch)) >> np.uint32(16), n_features)

    first: list[dict[int, int]] = [{} for _ in range(n_features)]
    for at, count in sorted(_sums(rows, upper).items()):
        first[at >> 16][at & 0xFFFF] = count
    heads, rest = [], []
    for counts in first:
        values, sums = np.array(list(counts)), np.cumsum(list(counts.values()))
        at = np.searchsorted(sums, ranks, "right")
        heads.append(values[at])
        rest.append(np.array(ranks) - np.where(at > 0, sums[at - 1], 0))
    wanted = [np.unique(h) for h in heads]
    begins = np.cumsum([0, *map(len, wanted)])

    def lower():
        def step(batch: pa.RecordBatch) -> np.ndarray:
            total = np.zeros(begins[-1] << 8, np.int64)
            for begin, some, bits in zip(begins, wanted, _sorted_bits(_features(batch)).T.astype(np.int64)):
                place = np.minimum(np.searchsorted(some, bits >> 16), len(some) - 1)
                near = some[place] == bits >> 16
                total += np.bincount((begin + place[near] << 8) + (bits[near] >> 8 & 0xFF), minlength=len(total))
            return total

        return step

    second = np.zeros(begins[-1] << 8, np.int64)
    for at, count in _sums(rows, lower).items():
        second[at] = count
    sums = np.cumsum(second.reshape(-1, 256), 1)
    edges = np.zeros((n_features, BINS - 1))
    for j in range(n_features):
        for k, (head, left) in enumerate(zip(heads[j], rest[j])):
            low = np.searchsorted(sums[begins[j] + np.searchsorted(wanted[j], head)], left, "right")
            edges[j, k] = _from_bits(np.array([(int(head) << 16) + (int(low) << 8)]))[0]
    return edges


def _counted(values: np.ndarray, n_features: int) -> np.ndarray:
    """How often each 16-bit value stands in each column."""
    places = values.astype(np.int64) + (np.arange(n_features) << 16)
    return np.bincount(places.ravel(), minlength=n_features << 16)


def pairs_of(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of different labels and their directions: every row of a label takes part as often as the others."""
    good, bad = (np.flatnonzero(labels == k) for k in (1, 0))
    most = max(len(good), len(bad))
    k = np.arange(4 * most if min(len(good), len(bad)) else 0)
    # The shift gives a row another partner on every turn.
    left, right = good[k % len(good)] if len(k) else k, bad[(k + k // most) % len(bad)] if len(k) else k
    # A preference either way round: the second half is the first one's mirror.
    return left, right, np.where(k % 2 == 0, 1, -1)


def _spread(bins: np.ndarray) -> np.ndarray:
    """Bins of some rows as zeros and ones."""
    out = np.zeros((len(bins), bins.shape[1] * BINS), np.float32)
    np.put_along_axis(out, bins.astype(np.int64) + np.arange(bins.shape[1]) * BINS, 1, 1)
    return out


def fit_pairs(groups: DataFrame, width: int, ridge: float = 3.0, steps: int = 12) -> np.ndarray:
    """Weights of the least logistic loss with a ridge over the pairs of all groups.

    Each Newton step sums the slope and the bend of every group. The sums of a group are rounded to a fixed
    fraction, so that the order in which they are added does not matter.
    """
    w = np.zeros(width)
    upper = np.triu_indices(width)
    for _ in range(steps):

        def run(batches: Iterator[pa.RecordBatch], w=w) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width + len(upper[0]), np.int64)
            for labels, bins in ((g, b) for batch in batches for g, b in zip(batch["labels"], batch["bins"])):
                x = _spread(np.frombuffer(b"".join(bins.as_py()), np.uint8).reshape(len(bins), -1))
                left, right, flip = pairs_of(labels.values.to_numpy())
                for begin in range(0, len(flip), 8_192):
                    some = slice(begin, begin + 8_192)
                    d = (x[left[some]] - x[right[some]]) * flip[some, None].astype(np.float32)
                    p = 1 / (1 + np.exp(-np.clip(d @ w.astype(np.float32), -30, 30)))
                    bend = (d * (p * (1 - p))[:, None].astype(np.float32)).T @ d
                    slope = d.T @ (p - (flip[some] > 0)).astype(np.float32)
                    total += np.rint(np.concatenate([slope, bend[upper]]).astype(float) * FRACTION).astype(np.int64)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["at", "n"])

        found = groups.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
        sums = np.zeros(width + len(upper[0]))
        for r in found:
            sums[r["at"]] = r["n"] / FRACTION
        bend = np.zeros((width, width))
        bend[upper] = sums[width:]
        bend = bend + np.triu(bend, 1).T
        move = np.linalg.solve(bend + ridge * np.eye(width), sums[:width] + ridge * w)
        w = w - move
        if np.abs(move).max() < 1e-3:
            break
    return w


def threshold_and_slope(counts: dict[int, int]) -> tuple[float, float]:
    """The strength that tells the labels apart best, and how steeply the chance of label 1 rises; ``counts`` by step and label."""
    steps = np.array(sorted({k >> 1 for k in counts}), np.int64)
    n0, n1 = (np.array([counts.get((int(s) << 1) + label, 0) for s in steps], float) for label in (0, 1))
    cuts = np.concatenate([[steps[0] - 1], (steps[1:] + steps[:-1]) / 2, [steps[-1] + 1]])
    below = lambda n: np.concatenate([[0], np.cumsum(n)]) / n.sum()
    right = 0.5 * (1 - below(n1)) + 0.5 * below(n0)
    # Of cuts that tell them apart almost equally well, the one that rejects least.
    threshold = float(cuts[right >= right.max() - SLACK][0]) / STEPS
    x = np.stack([steps / STEPS, np.ones(len(steps))], 1)
    w = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        weight = (n0 + n1) * p * (1 - p)
        move = np.linalg.solve((x * weight[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ ((n0 + n1) * p - n1) + 1e-2 * w)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return threshold, max(float(w[0]), 1e-3)


def train(docs: DataFrame, labels: DataFrame, group: int = GROUP) -> Model:
    """Learn from every labelled document outside the held-out fold.

    The weights come from three quarters of the rows, by a hash of doc_id, and the quantile and the slope from the
    rest. Pairs are made within groups of about ``group`` rows, dealt by another hash; every row takes part. Only
    counts and sums of a fixed number reach the driver. Rows that share a doc_id are documents each.
    """
    width = len(text_features(b""))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([text_features(t or b"") for t in raw(batch, "text")], np.float32)
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(list(found), pa.list_(pa.float32()))], ["doc_id", "f"])

        return step

    learned = per_batch(docs.where("doc_id is not null").where(fold(FOLDS) != HELD).select("doc_id", "text"), make, "doc_id long, f array<float>")
    rows = learned.join(labelled(labels, "quality", FOLDS, HELD), "doc_id")
    chosen = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("threshold")), F.lit(4)) == 0
    rows = materialize(rows.select("doc_id", "label", "f", chosen.alias("chosen")), "features")
    n = {(r["chosen"], r["label"]): r["n"] for r in rows.groupBy("chosen", "label").agg(F.count("*").alias("n")).collect()}
    if any(n.get((True, k), 0) + n.get((False, k), 0) < 4 for k in (0, 1)):
        return unscored(width)
    if len(n) < 4:  # too few to be apart
        fitted = judged = rows
    else:
        fitted, judged = rows.where("not chosen"), rows.where("chosen")
    size = fitted.count()
    edges = quantile_edges(fitted, width, size)

    def binned():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            bins = np.stack([np.searchsorted(cuts, column, "right") for cuts, column in zip(edges, _features(batch).T)], 1).astype(np.uint8)
            return pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array([b.tobytes() for b in bins], pa.binary())], ["doc_id", "label", "bins"])

        return step

    parts = -(-size // group)
    dealt = per_batch(fitted.select("doc_id", "label", "f"), binned, "doc_id long, label int, bins binary").withColumn("part", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("group")), F.lit(parts)))
    # A row for each group; its pairs follow from the order in it.
    order = F.array_sort(F.collect_list(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", "label", "bins")))
    groups = materialize(dealt.groupBy("part").agg(order.alias("r")).select(F.col("r.label").alias("labels"), "r.bins"), "groups")
    weights = fit_pairs(groups, width * BINS)

    def strengths():
        model = Model(edges, weights, 0.0, 1.0)

        def step(batch: pa.RecordBatch) -> np.ndarray:
            found = np.clip(np.rint(model.strengths(_features(batch)) * STEPS), -LIMIT, LIMIT).astype(np.int64) + LIMIT
            return np.bincount(found * 2 + batch["label"].to_numpy(), minlength=4 * LIMIT + 2)

        return step

    counts = _sums(judged.select("label", "f"), strengths)
    return Model(edges, weights, *threshold_and_slope({k - 2 * LIMIT: v for k, v in counts.items()}))


def _scores(model: Model, batch: pa.RecordBatch) -> np.ndarray:
    return model.scores(np.array([text_features(t or b"") for t in raw(batch, "text")], np.float32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every row. A null text is empty; repeated rows score alike; other columns are ignored."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(_scores(model, batch))], ["doc_id", "score"])

        return step

    return per_batch(docs.select("doc_id", "text"), make, "doc_id long, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose score reaches the threshold, all columns unchanged."""

    def make():
        return lambda batch: batch.filter(pa.array(_scores(model, batch) >= CUT))

    return per_batch(docs, make, docs.schema)


def held_out():
    return fold(FOLDS) == HELD
