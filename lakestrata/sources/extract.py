"""Reading source tables: full, incremental, snapshot and change-log extraction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestrata.operators.windows import keep_latest
from lakestrata.session import materialize
from lakestrata.sources.write import CSV_OPTIONS

# Rows per fetch from a database, and the bounds of a sample.
FETCH_SIZE = 100_000
SAMPLE_MIN, SAMPLE_MAX = 1, 20
PREVIEW_ROWS = 100
CORRUPT = "_corrupt_record"
_EMPTY = "\u0001"  # what two quotes are read as, for an empty text would be taken for null

# Public JDBC URL forms by database kind. Doris speaks the MySQL protocol.
JDBC_URLS = {
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
    "doris": "jdbc:mysql://{host}:{port}/{database}",
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={database}",
    "oracle": "jdbc:oracle:thin:@//{host}:{port}/{database}",
    "clickhouse": "jdbc:clickhouse://{host}:{port}/{database}",
}


def jdbc_options(
    kind: str,
    host: str,
    port: int,
    database: str,
    table: str | None = None,
    query: str | None = None,
    user: str = "",
    password: str = "",
    split: tuple[str, object, object, int] | None = None,
    fetch_size: int = FETCH_SIZE,
    extra: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Options of Spark's JDBC reader.

    ``split`` is (column, lowest, highest, partitions); without it the whole table arrives through
    one connection, so give it for anything large. Spark wants a table for a split read, so a
    query is wrapped as a derived table.
    """
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    if kind not in JDBC_URLS:
        raise ValueError(f"unknown database kind {kind!r}; known: {', '.join(sorted(JDBC_URLS))}")
    options = {
        "url": JDBC_URLS[kind].format(host=host, port=port, database=database),
        "user": user,
        "password": password,
        "fetchsize": str(fetch_size),
        **(extra or {}),
    }
    if split:
        column, low, high, parts = split
        options["dbtable"] = table or f"({query}) q"
        options.update(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    elif table:
        options["dbtable"] = table
    else:
        options["query"] = query
    return options


def read_jdbc(spark: SparkSession, **settings) -> DataFrame:
    """A database table or query; filters and column choices on the result are pushed down."""
    return spark.read.format("jdbc").options(**jdbc_options(**settings)).load()


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A Hive or session catalog table."""
    return spark.table(name)


def extract_full(source: DataFrame, columns: Sequence[str] = (), filters: Sequence[str] = ()) -> DataFrame:
    """All rows that meet every filter; no columns means all of them."""
    kept = source
    for condition in filters:
        kept = kept.where(condition)
    return kept.select(*columns) if columns else kept


def extract_query(spark: SparkSession, query: str, **arguments) -> DataFrame:
    return spark.sql(query, args=arguments) if arguments else spark.sql(query)


def extract_incremental(source: DataFrame, column: str, last: object | None) -> tuple[DataFrame, DataFrame]:
    """Rows above the last watermark, and a one-row frame with the next one.

    The watermark is settled first and bounds the rows, so what arrives in between is left to
    the next run. The first run passes ``None`` and takes everything, rows without a mark included. When
    nothing new arrived the watermark stays where it was.
    """
    fresh = source if last is None else source.where(F.col(column) > F.lit(last))
    kind = source.schema[column].dataType
    settled = fresh.agg(F.coalesce(F.max(column), F.lit(last).cast(kind)).alias("watermark")).collect()
    mark = source.sparkSession.createDataFrame(settled, T.StructType([T.StructField("watermark", kind)]))
    below = F.col(column) <= F.lit(settled[0][0]).cast(kind)
    return fresh.where(F.col(column).isNull() | below), mark


def extract_snapshot(source: DataFrame, bizdate: str, partition: str = "dt") -> DataFrame:
    """The whole source stamped with its business date."""
    return source.withColumn(partition, F.lit(bizdate))


def extract_cdc(
    log: DataFrame, keys: Sequence[str], sequence: str, operation: str, deleted: Sequence[str] = ("d", "delete")
) -> DataFrame:
    """Current state from a change log: the last change per key, without deleted keys.

    Operations are compared in lower case; a change without one is no deletion.
    """
    latest = keep_latest(log, keys, sequence)
    gone = F.lower(F.col(operation)).isin(*(d.lower() for d in deleted))
    return latest.where(~F.coalesce(gone, F.lit(False))).drop(operation, sequence)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """CSV with a header line, into an existing schema, columns matched by name.

    Only the header is read ahead. Columns of the schema that the file lacks become NULL, columns
    it has besides are dropped, and a later file with another header is an error. Cells that do not fit their type are NULL; ``read_csv_checked`` keeps such rows apart.
    Values may hold line breaks; a file is then read by one task, so write large exports as several files, as ``export_csv`` does, or give up line breaks with ``multi_line=False``.
    """
    return _parse_csv(spark, path, schema, multi_line).drop(CORRUPT)


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows that fit the schema, and of all others the file and the text as it stands there."""
    parsed = materialize(_parse_csv(spark, path, schema, multi_line).withColumn("file", F.input_file_name()), "csv")
    held = parsed.where(F.col(CORRUPT).isNotNull()).select("file", F.col(CORRUPT).alias("record"))
    return parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "file"), held


def _parse_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    options = {**CSV_OPTIONS, "emptyValue": _EMPTY, "multiLine": str(multi_line).lower(), "columnNameOfCorruptRecord": CORRUPT}
    header = spark.read.options(**options).csv(path).columns
    wanted = {f.name.lower(): f for f in schema.fields}
    found = [wanted.get(h.lower(), T.StructField(h, T.StringType())) for h in header]
    in_file = T.StructType([*(T.StructField(h, f.dataType, True) for h, f in zip(header, found)), T.StructField(CORRUPT, T.StringType())])
    raw = spark.read.options(**options).option("enforceSchema", False).schema(in_file).csv(path)
    have = {h.lower(): h for h in header}

    def value(f: T.StructField) -> Column:
        if f.name.lower() not in have:
            return F.lit(None).cast(f.dataType)
        c = F.col(f"`{have[f.name.lower()]}`")
        return F.when(c == _EMPTY, "").otherwise(c) if isinstance(f.dataType, T.StringType) else c

    return raw.select(*[value(f).alias(f.name) for f in schema.fields], CORRUPT)


def preview(df: DataFrame, max_rows: int = PREVIEW_ROWS) -> DataFrame:
    return df.limit(max_rows)


def sample_head(df: DataFrame, limit: int = 5) -> DataFrame:
    """The first few rows, between 1 and 20; a look at the data, not a random sample."""
    return df.limit(max(SAMPLE_MIN, min(limit, SAMPLE_MAX)))
