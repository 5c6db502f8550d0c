"""A bounded sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestrata.session import materialize

PER_LABEL = 8_000  # training documents of each label; the only bound in a fit


def fold(folds: int) -> Column:
    """The fold of a document: unsigned crc32 of its doc_id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


def labelled(labels: DataFrame, column: str, folds: int, held: int) -> DataFrame:
    """(doc_id, label) outside the held-out fold, one row a document; null ids and labels are left out, 1 beats 0."""
    rows = labels.select("doc_id", F.col(column).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    return rows.where(fold(folds) != held).groupBy("doc_id").agg(F.max("label").alias("label"))


def training_sample(docs: DataFrame, labels: DataFrame, column: str, folds: int, held: int, per_label: int = PER_LABEL) -> tuple[DataFrame, dict[int, int]]:
    """Texts and labels of at most ``per_label`` documents of each label, picked by a hash of doc_id, and all labels' counts.

    The ids are bounded by ``per_label``, so they may be broadcast. The texts are written once to the shared folder.
    """
    rows = labelled(labels, column, folds, held)
    counts = {0: 0, 1: 0} | {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id"), F.col("doc_id")
    parts = [rows.where(F.col("label") == k).orderBy(*order).limit(per_label) for k in (0, 1)]
    picked = parts[0].unionByName(parts[1])
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return materialize(texts, "labelled"), counts
