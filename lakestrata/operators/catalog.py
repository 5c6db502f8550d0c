"""The table catalog as a table: registration, search, statistics and dictionary.

An entry has connection_id, full_name, table_name, description, layer, category, status,
sensitivity, owner, row_count, tags (array of strings) and columns (array of name, description).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestrata.operators.load import same_keys
from lakestrata.functions.text import present

# Tenths of a point per kind of match, the cap, and list lengths.
NAME, FULL_NAME, DESCRIPTION, COLUMN, COLUMN_TEXT, TAG, CAP = 5, 3, 3, 2, 1, 2, 10
SEARCH_LIMIT, TOP_TAGS = 50, 20
FILTERS = ("layer", "category", "connection_id", "status", "sensitivity", "owner")

# Order of layers in the dictionary; anything else comes last.
LAYER_ORDER = {"ods": 0, "dwd": 1, "dim": 2, "dws": 3, "ads": 4}
KEY = ["connection_id", "full_name"]


def matching(catalog: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """Entries equal to every filter."""
    for name, value in filters.items():
        if name not in FILTERS:
            raise ValueError(f"cannot filter by {name!r}")
        catalog = catalog.where(F.col(name) == value)
    return catalog


def search(catalog: DataFrame, keyword: str, filters: Mapping[str, str] | None = None, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Entries that contain the keyword, best first: (…entry, score, matched_fields).

    Points add up over name, full name, description, columns and tags and are capped at 1. Equal
    scores are ordered by full name and connection.
    """
    word = keyword.lower()

    def hit(c: Column) -> Column:
        return F.lower(F.coalesce(c, F.lit(""))).contains(word)

    # An entry without columns or tags is searched by the rest, and comes back as it was.
    filled = {c: F.coalesce(F.col(c), F.array().cast(catalog.schema[c].dataType)) for c in ("columns", "tags")}
    by_name = F.filter(filled["columns"], lambda c: hit(c["name"]))
    by_text = F.filter(filled["columns"], lambda c: hit(c["description"]))
    by_tag = F.filter(filled["tags"], hit)
    points = (
        F.when(hit(F.col("table_name")), NAME).otherwise(0)
        + F.when(hit(F.col("full_name")), FULL_NAME).otherwise(0)
        + F.when(hit(F.col("description")), DESCRIPTION).otherwise(0)
        + F.size(by_name) * COLUMN
        + F.size(by_text) * COLUMN_TEXT
        + F.size(by_tag) * TAG
    )
    fields = F.concat(
        present(
            F.array(
                F.when(hit(F.col("table_name")), "table_name"),
                F.when(hit(F.col("full_name")), "full_name"),
                F.when(hit(F.col("description")), "description"),
            )
        ),
        F.transform(by_name, lambda c: F.concat(F.lit("column:"), c["name"])),
        F.transform(by_text, lambda c: F.concat(F.lit("column_desc:"), c["name"])),
        F.transform(by_tag, lambda x: F.concat(F.lit("tag:"), x)),
    )
    scored = matching(catalog, filters or {}).withColumn("_points", points).where(F.col("_points") > 0)
    ranked = scored.select("*", (F.least("_points", F.lit(CAP)) / F.lit(10.0)).alias("score"), fields.alias("matched_fields"))
    return ranked.drop("_points").orderBy(F.desc("score"), "full_name", "connection_id").limit(limit)


def _is_empty(c: Column, kind: T.DataType, name: str) -> Column:
    if isinstance(kind, T.StringType):
        return c.isNull() | (c == "") | ((c == "other") if name == "category" else F.lit(False))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return c.isNull() | (F.size(c) == 0)
    if isinstance(kind, T.NumericType):
        return c.isNull() | (c == 0)
    return c.isNull()


#: What an update of a known entry may change; everything else (owner, status, when it was made, ...) stays as it is.
UPDATED = ("description", "columns", "primary_keys", "foreign_keys", "row_count", "size_bytes", "tags", "updated_at", "layer", "category")


def register(catalog: DataFrame, entries: DataFrame) -> DataFrame:
    """Add new entries and update known ones: in the fields ``UPDATED`` a new value wins unless it is empty.

    Empty is NULL, an empty text, list or map, the number 0, and the category ``other``. ``entries``
    has one row per (connection_id, full_name). The catalog is joined as the left side, so a small batch is broadcast
    and the catalog is not moved; what is new to it comes from an anti join.
    """
    names = [f"_k_{k}" for k in KEY]
    updated = [c for c in catalog.columns if c in UPDATED and c in entries.columns]
    news = entries.select(*[F.col(k).alias(n) for k, n in zip(KEY, names)], *[F.col(c).alias(f"_n_{c}") for c in updated], F.lit(True).alias("_new"))
    both = catalog.join(news, same_keys(KEY, names), "left")
    merged = [
        F.when(F.col("_new") & ~_is_empty(F.col(f"_n_{c}"), catalog.schema[c].dataType, c), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in updated else F.col(c)
        for c in catalog.columns
    ]
    known = catalog.select(*[F.col(k).alias(n) for k, n in zip(KEY, names)])
    fresh = entries.join(known, same_keys(KEY, names), "left_anti")
    given = [F.col(f.name) if f.name in entries.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in catalog.schema.fields]
    return both.select(*merged).unionByName(fresh.select(*given))


def statistics(catalog: DataFrame) -> DataFrame:
    """(dimension, value, n): totals, and entries by layer, category and connection."""
    layer = F.when(F.coalesce(F.col("layer"), F.lit("")) == "", "unknown").otherwise(F.col("layer"))

    def part(dimension: str, value: Column, n: Column) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), value.cast("string").alias("value"), n.cast("long").alias("n"))

    one = F.lit(1)
    facts = F.array(
        part("total", F.lit("tables"), one),
        part("total", F.lit("columns"), F.size("columns")),
        part("layer", layer, one),
        part("category", F.col("category"), one),
        part("connection", F.col("connection_id"), one),
    )
    return catalog.select(F.inline(facts)).groupBy("dimension", "value").agg(F.sum("n").alias("n"))


def top_tags(catalog: DataFrame, limit: int = TOP_TAGS) -> DataFrame:
    """The most used tags; equal counts are ordered by tag."""
    used = catalog.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return used.orderBy(F.desc("n"), "tag").limit(limit)


def _layer_rank() -> Column:
    layer = F.lower("layer")
    return F.coalesce(*[F.when(layer == name, F.lit(rank)) for name, rank in LAYER_ORDER.items()], F.lit(99)).cast("long")


def dictionary(catalog: DataFrame, connection: str | None = None) -> DataFrame:
    """Entries in dictionary order: by layer, then by name."""
    chosen = catalog if connection is None else catalog.where(F.col("connection_id") == connection)
    return chosen.withColumn("layer_rank", _layer_rank()).orderBy("layer_rank", "table_name", "full_name")


def dictionary_summary(catalog: DataFrame) -> DataFrame:
    """Tables and columns per connection and layer."""
    layer = F.when(F.coalesce(F.col("layer"), F.lit("")) == "", "unknown").otherwise(F.col("layer"))
    return catalog.groupBy("connection_id", layer.alias("layer")).agg(
        F.count("*").alias("n_tables"), F.sum(F.size("columns")).alias("n_columns")
    )
