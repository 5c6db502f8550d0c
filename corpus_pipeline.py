"""From raw documents to packed sequences: five stages, each over all that the stage before kept.

A document that its quality score rejects goes, then one that is toxic, then all of a near-duplicate group but its
smallest doc_id; then passages that an earlier document holds are removed, and what is left is packed.
Classifiers learn from the labels of the same folder. A stage is a function of (spark, docs, sf_dir).

Null and empty texts are documents like others; a row with a null doc_id passes every stage that needs a name for it;
rows that share a doc_id are one document and stay or go together in the near-duplicate stage. Every
stage but the last returns all columns it was given, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestrata.llm import minhash, packing, quality, substrings, toxicity
from lakestrata.llm.shared import table
from lakestrata.session import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a smaller doc_id of their group stands for."""
    gone = minhash.similar_documents(docs).where("not kept").select("doc_id").distinct()
    return docs.join(materialize(gone, "gone"), "doc_id", "left_anti").select(docs.columns)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.remove(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.word_count(F.col("text")))


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("MinHash near-dedup", one_of_each),
    ("substring dedup", no_repeats),
    ("best-fit packing", sequences),
]

#: Trained scores and packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
