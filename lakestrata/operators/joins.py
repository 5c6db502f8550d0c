"""Joins a layered warehouse needs beyond the plain equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrich(fact: DataFrame, dimension: DataFrame, on: dict[str, str], attributes: dict[str, str]) -> DataFrame:
    """Left join that copies ``attributes`` (new name -> dimension column) onto the fact.

    No broadcast is forced: Spark broadcasts the dimension when its measured size is below the
    threshold and otherwise shuffles and splits hot keys.
    """
    dim = dimension.select(
        *[F.col(d).alias(f"_d_{d}") for d in on.values()],
        *[F.col(src).alias(dst) for dst, src in attributes.items()],
    )
    matches = [F.col(f) == F.col(f"_d_{d}") for f, d in on.items()]
    return fact.join(dim, matches, "left").select(*fact.columns, *attributes)


def orphan_keys(fact: DataFrame, foreign_key: str, dimension: DataFrame, key: str) -> DataFrame:
    """Foreign keys with no dimension row, and how many fact rows carry each.

    NULL keys refer to nothing and are not orphans. The fact shrinks to its distinct keys before
    it meets the dimension.
    """
    used = fact.where(F.col(foreign_key).isNotNull()).groupBy(foreign_key).agg(F.count("*").alias("n_rows"))
    return used.join(dimension.select(F.col(key).alias("_pk")), F.col(foreign_key) == F.col("_pk"), "left_anti")


def not_in(left: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of ``left`` without a partner, in the NOT EXISTS sense.

    A NULL key on the left is kept and a NULL on the right is ignored, where SQL's NOT IN would
    lose rows.
    """
    keys = right.select(*[F.col(r).alias(f"_r_{r}") for r in on.values()])
    matches = [F.col(a) == F.col(f"_r_{b}") for a, b in on.items()]
    return left.join(keys, matches, "left_anti")


def is_in(left: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    keys = right.select(*[F.col(r).alias(f"_r_{r}") for r in on.values()])
    matches = [F.col(a) == F.col(f"_r_{b}") for a, b in on.items()]
    return left.join(keys, matches, "left_semi")


def distinct_rows(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(keys)) if keys else df.distinct()
