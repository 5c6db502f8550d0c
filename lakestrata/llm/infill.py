"""Fill-in-the-middle texts, cut at characters through a piecewise-linear rank index.

Cuts are places between code points, texts are UTF-8 bytes. Where the k-th code point begins is a rising sequence of offsets,
nearly a straight line wherever one script is used. The index covers all offsets of a text by segments whose lines miss none by more than
``ERROR`` bytes, and keeps what each line misses as one signed byte. A cut is found by its segment's line and
corrected by the stored residual, so it is exact, and the text is never scanned again.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestrata.llm.shared import per_batch, raw

ERROR = 100  # bytes that a line may miss an offset by; residuals fit a signed byte
FIRST_STRETCH = 256

# The marks and the shares of plain texts and of suffix-first order, in per cent.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
CHANGED, SUFFIX_FIRST = 90, 20


def offsets(data: bytes) -> np.ndarray:
    """Where each code point of UTF-8 bytes begins, and where the last one ends."""
    found = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return np.append(found, len(data)).astype(np.int64)


def fit(y: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray]:
    """First places and slopes of segments that cover ``y``: a line starts at its first value and misses none by more than ``error``.

    Each segment takes as many values as one line through its first can serve: the slopes that all values so far allow
    narrow down until none is left. They are looked at in stretches that double, so long segments cost a few passes.
    """
    begins, slopes, at = [], [], 0
    while at < len(y):
        low, high, slope, done, stretch = 0.0, np.inf, 0.0, at + 1, FIRST_STRETCH
        while done < len(y):
            part = y[done : done + stretch] - y[at]
            steps = np.arange(done - at, done - at + len(part))
            lows = np.maximum.accumulate(np.maximum((part - error) / steps, low))
            highs = np.minimum.accumulate(np.minimum((part + error) / steps, high))
            bad = lows > highs
            n = int(bad.argmax()) if bad.any() else len(part)
            if n:
                low, high = lows[n - 1], highs[n - 1]
                slope = (low + high) / 2
            done += n
            if n < len(part):
                break
            stretch *= 2
        begins.append(at)
        slopes.append(slope)
        at = done
    return np.array(begins, np.int64), np.array(slopes)


class RankIndex(NamedTuple):
    """Offsets of all code points of a text, as lines and residuals; small enough to store beside it."""

    begins: np.ndarray  # first place of each segment
    bases: np.ndarray  # its offset
    slopes: np.ndarray
    residuals: np.ndarray  # int8, one for each place

    @classmethod
    def of(cls, data: bytes, error: int = ERROR) -> RankIndex:
        if error > 100:
            raise ValueError("residuals are kept in one signed byte")
        y = offsets(data)
        begins, slopes = fit(y, error)
        index = cls(begins, y[begins], slopes, np.zeros(0, np.int8))
        return index._replace(residuals=(y - index.predict(np.arange(len(y)))).astype(np.int8))

    @property
    def chars(self) -> int:
        """Code points of the text."""
        return len(self.residuals) - 1

    def predict(self, places: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.begins, places, "right") - 1
        return self.bases[segment] + np.rint(self.slopes[segment] * (places - self.begins[segment])).astype(np.int64)

    def cut(self, *places: int) -> list[int]:
        """The exact byte offsets of some places."""
        at = np.array(places, np.int64)
        return (self.predict(at) + self.residuals[at]).tolist()


def draws(doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit numbers that depend on the id only; a null id counts as empty text."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return np.frombuffer(digest[:16], ">u4").tolist()


def transform(data: bytes, index: RankIndex, doc_id: int | None) -> tuple[str, int | None, int | None, bytes]:
    """Form, code points of prefix and of middle, and the text in that form."""
    n, (h1, h2, h3, h4) = index.chars, draws(doc_id)
    if not n or h3 % 100 >= CHANGED or any(m in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", None, None, data
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = index.cut(first, last)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return "spm", first, last - first, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return "psm", first, last - first, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def restore(form: str, output: bytes) -> bytes:
    """The original text, from the output and its form alone."""
    if form == "plain":
        return output
    rest, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = rest[len(PREFIX) :].split(SUFFIX)
    else:
        suffix, prefix = rest[len(SUFFIX) :].split(PREFIX)
    return prefix + middle + suffix


def _rows(docs: DataFrame, schema: str, row) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [row(i, t or b"") for i, t in zip(batch["doc_id"].to_pylist(), raw(batch, "text"))]
            kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            columns = [pa.array(c, kinds[part.split()[1]]) for c, part in zip(zip(*out), schema.split(", "))]
            return pa.RecordBatch.from_arrays(columns, names)

        return step

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), make, schema)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row.

    A null or empty text is plain and empty, and so is every text that holds a mark already; plain rows have null counts. A null doc_id
    is drawn for as empty text; rows that share a doc_id share their draws, and repeated rows come out alike. Other columns are
    ignored; no rows give none.
    """

    def row(doc_id, data):
        index = RankIndex.of(data)
        form, prefix, middle, output = transform(data, index, doc_id)
        return doc_id, index.chars, form, prefix, middle, output.decode()

    return _rows(docs, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", row)


def digests(docs: DataFrame) -> DataFrame:
    """What ``fill_in_middle`` gives, with SHA-256 of each output and of the text restored from it instead of the texts."""

    def row(doc_id, data):
        index = RankIndex.of(data)
        form, prefix, middle, output = transform(data, index, doc_id)
        return doc_id, index.chars, form, prefix, middle, hashlib.sha256(output).hexdigest(), hashlib.sha256(restore(form, output)).hexdigest()

    kind = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return _rows(docs, kind, row)


def rank_indexes(docs: DataFrame) -> DataFrame:
    """doc_id and the stored index of every row's text; ``stored_index`` reads one back. A null text has the index of an empty one."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [RankIndex.of(t or b"") for t in raw(batch, "text")]
            columns = [
                batch["doc_id"].cast(pa.int64()),
                pa.array([i.begins.tolist() for i in found], pa.list_(pa.int64())),
                pa.array([i.bases.tolist() for i in found], pa.list_(pa.int64())),
                pa.array([i.slopes.tolist() for i in found], pa.list_(pa.float64())),
                pa.array([i.residuals.tobytes() for i in found], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "begins", "bases", "slopes", "residuals"])

        return step

    return per_batch(docs.select("doc_id", "text"), make, "doc_id long, begins array<long>, bases array<long>, slopes array<double>, residuals binary")


def stored_index(row) -> RankIndex:
    return RankIndex(np.array(row["begins"], np.int64), np.array(row["bases"], np.int64), np.array(row["slopes"]), np.frombuffer(row["residuals"], np.int8))
