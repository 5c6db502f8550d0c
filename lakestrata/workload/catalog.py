"""Catalog jobs; each part is one catalog entry."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakestrata.operators import catalog as K
from lakestrata.operators import route as R
from lakestrata.workload import query

_CATALOG = """
    cat AS (SELECT p_brand AS connection_id, lower(p_type) || '.' || replace(p_name, ' ', '_') || '_' || p_partkey AS full_name,
              replace(p_name, ' ', '_') || '_' || p_partkey AS table_name,
              CASE WHEN p_size < 10 THEN '' ELSE p_type || ' ' || p_name END AS description,
              CASE WHEN p_size < 10 THEN '' WHEN p_size < 20 THEN 'ods' WHEN p_size < 30 THEN 'dwd' WHEN p_size < 40 THEN 'dws' ELSE 'legacy' END AS layer,
              CASE WHEN p_size < 25 THEN 'fact' ELSE 'other' END AS category, p_size AS row_count,
              [p_type, split_part(p_name, ' ', 1)] AS tags,
              [{'name': split_part(p_name, ' ', 2) || '_id', 'description': p_type}, {'name': 'amount', 'description': p_name}] AS columns
            FROM part)
"""


def catalog(t):
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"))
    size = F.col("p_size")
    layer = F.when(size < 10, "").when(size < 20, "ods").when(size < 30, "dwd").when(size < 40, "dws").otherwise("legacy")

    def column(n, d):
        return F.struct(n.alias("name"), d.alias("description"))

    return t.part.select(
        F.col("p_brand").alias("connection_id"),
        F.concat(F.lower("p_type"), F.lit("."), name).alias("full_name"),
        name.alias("table_name"),
        F.when(size < 10, "").otherwise(F.concat("p_type", F.lit(" "), "p_name")).alias("description"),
        layer.alias("layer"),
        F.when(size < 25, "fact").otherwise("other").alias("category"),
        size.cast("long").alias("row_count"),
        F.array("p_type", first).alias("tags"),
        F.array(column(F.concat(second, F.lit("_id")), F.col("p_type")), column(F.lit("amount"), F.col("p_name"))).alias("columns"),
    )


@query(
    "catalog_search",
    "K2 K3",
    f"""
    WITH {_CATALOG},
    s AS (SELECT *, (CASE WHEN contains(lower(table_name), 'ring') THEN 5 ELSE 0 END) + (CASE WHEN contains(lower(full_name), 'ring') THEN 3 ELSE 0 END)
            + (CASE WHEN contains(lower(description), 'ring') THEN 3 ELSE 0 END)
            + 2 * len(list_filter(columns, lambda c: contains(lower(c.name), 'ring'))) + len(list_filter(columns, lambda c: contains(lower(c.description), 'ring')))
            + 2 * len(list_filter(tags, lambda x: contains(lower(x), 'ring'))) AS p,
            list_concat(
              list_filter([CASE WHEN contains(lower(table_name), 'ring') THEN 'table_name' END, CASE WHEN contains(lower(full_name), 'ring') THEN 'full_name' END,
                           CASE WHEN contains(lower(description), 'ring') THEN 'description' END], lambda x: x IS NOT NULL),
              [('column:' || c.name) for c in columns if contains(lower(c.name), 'ring')],
              [('column_desc:' || c.name) for c in columns if contains(lower(c.description), 'ring')],
              [('tag:' || x) for x in tags if contains(lower(x), 'ring')]) AS m
          FROM cat WHERE category = 'fact')
    SELECT connection_id, full_name, LEAST(p, 10) / 10.0::DOUBLE AS score, array_to_string(m, ',') AS matched FROM s WHERE p > 0
    ORDER BY score DESC, full_name, connection_id LIMIT 50
    """,
)
def catalog_search(t):
    found = K.search(catalog(t), "Ring", {"category": "fact"})
    return found.select("connection_id", "full_name", "score", F.array_join("matched_fields", ",").alias("matched"))


@query(
    "catalog_statistics",
    "K4",
    f"""
    WITH {_CATALOG}
    SELECT 'total' AS dimension, 'tables' AS value, COUNT(*) AS n FROM cat
    UNION ALL SELECT 'total', 'columns', CAST(SUM(len(columns)) AS BIGINT) FROM cat
    UNION ALL SELECT 'layer', CASE WHEN layer = '' THEN 'unknown' ELSE layer END, COUNT(*) FROM cat GROUP BY 2
    UNION ALL SELECT 'category', category, COUNT(*) FROM cat GROUP BY 2
    UNION ALL SELECT 'connection', connection_id, COUNT(*) FROM cat GROUP BY 2
    """,
)
def catalog_statistics(t):
    return K.statistics(catalog(t))


@query(
    "top_tags",
    "T5 K4",
    f"WITH {_CATALOG} SELECT tag, COUNT(*) AS n FROM (SELECT UNNEST(tags) AS tag FROM cat) GROUP BY tag ORDER BY n DESC, tag LIMIT 20",
)
def top_tags(t):
    return K.top_tags(catalog(t))


@query(
    "data_dictionary",
    "K5 T6",
    f"""
    WITH {_CATALOG}
    SELECT full_name, table_name, CAST(CASE layer WHEN 'ods' THEN 0 WHEN 'dwd' THEN 1 WHEN 'dim' THEN 2 WHEN 'dws' THEN 3 WHEN 'ads' THEN 4 ELSE 99 END AS BIGINT) AS layer_rank
    FROM cat ORDER BY layer_rank, table_name
    """,
)
def data_dictionary(t):
    return K.dictionary(catalog(t)).select("full_name", "table_name", "layer_rank")


@query(
    "dictionary_summary",
    "K5",
    f"""
    WITH {_CATALOG}
    SELECT connection_id, CASE WHEN layer = '' THEN 'unknown' ELSE layer END AS layer, COUNT(*) AS n_tables, CAST(SUM(len(columns)) AS BIGINT) AS n_columns
    FROM cat GROUP BY 1, 2
    """,
)
def dictionary_summary(t):
    return K.dictionary_summary(catalog(t))


@query(
    "catalog_register",
    "K1 S16 F8",
    f"""
    WITH {_CATALOG},
    news AS (SELECT connection_id, full_name, CASE WHEN layer = 'ods' THEN '' ELSE 'renewed' END AS description,
               CASE WHEN layer = 'dwd' THEN 'other' ELSE 'dimension' END AS category, CASE WHEN layer = 'dws' THEN 0 ELSE row_count + 1 END AS row_count,
               CASE WHEN layer = 'legacy' THEN CAST([] AS VARCHAR[]) ELSE ['new'] END AS tags FROM cat WHERE category = 'other'
             UNION ALL SELECT 'added', full_name, description, category, row_count, tags FROM cat WHERE layer = ''),
    j AS (SELECT COALESCE(c.connection_id, n.connection_id) AS connection_id, COALESCE(c.full_name, n.full_name) AS full_name,
            c.full_name IS NULL AS fresh, n.full_name IS NOT NULL AS given, c.description AS d0, n.description AS d1, c.category AS c0, n.category AS c1,
            c.row_count AS r0, n.row_count AS r1, c.tags AS t0, n.tags AS t1
          FROM cat c FULL JOIN news n ON c.connection_id = n.connection_id AND c.full_name = n.full_name)
    SELECT connection_id, full_name, CASE WHEN fresh OR (given AND d1 <> '') THEN d1 ELSE d0 END AS description,
           CASE WHEN fresh OR (given AND c1 NOT IN ('', 'other')) THEN c1 ELSE c0 END AS category,
           CAST(CASE WHEN fresh OR (given AND r1 <> 0) THEN r1 ELSE r0 END AS BIGINT) AS row_count,
           array_to_string(CASE WHEN fresh OR (given AND len(t1) > 0) THEN t1 ELSE t0 END, ',') AS tags FROM j
    """,
)
def catalog_register(t):
    columns = ["connection_id", "full_name", "description", "category", "row_count", "tags"]
    base = catalog(t)
    layer = F.col("layer")
    changed = base.where("category = 'other'").select(
        "connection_id",
        "full_name",
        F.when(layer == "ods", "").otherwise("renewed").alias("description"),
        F.when(layer == "dwd", "other").otherwise("dimension").alias("category"),
        F.when(layer == "dws", 0).otherwise(F.col("row_count") + 1).cast("long").alias("row_count"),
        F.when(layer == "legacy", F.array().cast("array<string>")).otherwise(F.array(F.lit("new"))).alias("tags"),
    )
    added = base.where("layer = ''").withColumn("connection_id", F.lit("added")).select(*columns)
    merged = K.register(base.select(*columns), changed.unionByName(added))
    return merged.withColumn("tags", F.array_join("tags", ","))


_WORDS = {
    "governance": ("the", "tion", "sh"),
    "ddl_build": ("le ", "eux", "ment", "é"),
    "sql_query": ("en", "er"),
}


@query(
    "route_messages",
    "R1",
    "WITH h AS (SELECT conv_id, turn, "
    + ", ".join(
        " + ".join(f"CAST(contains(lower(text), '{w}') AS BIGINT)" for w in words) + f" AS {label}" for label, words in _WORDS.items()
    )
    + """ FROM conversations)
    SELECT conv_id, turn, CASE WHEN GREATEST(governance, ddl_build, sql_query) = 0 THEN 'unknown'
             WHEN governance = GREATEST(governance, ddl_build, sql_query) THEN 'governance'
             WHEN ddl_build = GREATEST(governance, ddl_build, sql_query) THEN 'ddl_build' ELSE 'sql_query' END AS label,
           GREATEST(governance, ddl_build, sql_query) AS score FROM h
    """,
)
def route_messages(t):
    return R.route(t.conversations, "text", _WORDS).select("conv_id", "turn", "label", "score")


@query(
    "route_by_default_keywords",
    "R1",
    "WITH h AS (SELECT conv_id, turn, "
    + ", ".join(
        " + ".join(f"CAST(contains(lower(text), '{w}') AS BIGINT)" for w in words) + f" AS {label}" for label, words in R.INTENT_KEYWORDS.items()
    )
    + """ FROM conversations)
    SELECT conv_id, turn, CASE WHEN GREATEST(sql_query, ddl_build, data_governance) = 0 THEN 'unknown'
             WHEN sql_query = GREATEST(sql_query, ddl_build, data_governance) THEN 'sql_query'
             WHEN ddl_build = GREATEST(sql_query, ddl_build, data_governance) THEN 'ddl_build' ELSE 'data_governance' END AS label FROM h
    """,
)
def route_by_default_keywords(t):
    return R.route(t.conversations, "text").select("conv_id", "turn", "label")
