"""Lineage as edge tables: extraction from a statement log, tracing, cycles and compliance."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestrata.functions import statements as S
from lakestrata.operators.audit import placement_problems
from lakestrata.operators.load import upsert
from lakestrata.session import deal, materialize, scratch_path

# Statement shapes that name a target, tried in this order.
TARGET_PATTERNS = (
    ("INSERT INTO", rf"(?is)INSERT\s+(?:INTO|OVERWRITE)\s+(?:TABLE\s+)?({S.NAME})"),
    ("CTAS", rf"(?is)CREATE\s+(?:OR\s+REPLACE\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({S.NAME})\s+AS\s+(?:SELECT|WITH|\()"),
    ("MERGE", rf"(?is)MERGE\s+INTO\s+({S.NAME})"),
)
NOT_A_TABLE = ("SELECT", "DUAL", "LATERAL", "")

SPREAD = 8  # tasks that the edges of one bucket are dealt to

# Which layer may feed which.
ALLOWED_TRANSITIONS = (
    ("ODS", "DWD"),
    ("DWD", "DWS"),
    ("DWS", "ADS"),
    ("DWD", "ADS"),
    ("DWD", "DIM"),
    ("ODS", "TMP"),
    ("DWD", "TMP"),
)

# Words that end a FROM clause, and words that are no alias after a table name.
_CLAUSES = "WHERE|GROUP|HAVING|ORDER|SORT|CLUSTER|DISTRIBUTE|LIMIT|OFFSET|WINDOW|QUALIFY|UNION|EXCEPT|INTERSECT|MINUS|SELECT|INSERT|WHEN"
_LIST_ENDS = "FROM|WHERE|GROUP|HAVING|ORDER|LIMIT|UNION|EXCEPT|INTERSECT|MINUS"
_NO_ALIAS = f"{_CLAUSES}|ON|USING|JOIN|INNER|LEFT|RIGHT|FULL|CROSS|NATURAL|SEMI|ANTI|LATERAL|SET|TABLESAMPLE|PIVOT|UNPIVOT|AS"
# Words within an expression that name no column.
_NO_COLUMN = (
    "CASE", "WHEN", "THEN", "ELSE", "END", "AND", "OR", "NOT", "NULL", "IS", "IN", "LIKE", "RLIKE", "ILIKE", "BETWEEN", "AS", "DISTINCT", "ALL", "ANY", "EXISTS",
    "OVER", "PARTITION", "BY", "ORDER", "ASC", "DESC", "NULLS", "FIRST", "LAST", "ROWS", "RANGE", "UNBOUNDED", "PRECEDING", "FOLLOWING", "CURRENT", "ROW",
    "TRUE", "FALSE", "INTERVAL", "DATE", "TIMESTAMP", "FILTER", "WHERE", "WITHIN", "GROUP", "ESCAPE", "DIV", "MOD", "XOR", "FROM", "COLLATE",
)
_TABLE_ITEM = rf"(?is)(?:,|\bJOIN\b|^)\s*+(?:(?:LATERAL|ONLY)\s++)?+({S.NAME}|{S.BRACKETS})(?!\s*+\()(?:\s++(?:AS\s++)?+((?!(?:{_NO_ALIAS})\b)(?:[\w$]++|`[^`]++`)))?+"
_FROM = rf"(?is)\bFROM\b(?=\s*+({S.until(_CLAUSES + '|FROM')}))"
_CTE = rf"(?is)(?:\bWITH(?:\s++RECURSIVE)?+|,)\s*+([\w$]++|`[^`]++`)\s*+(?:\([^()]*+\)\s*+)?+AS\s*+({S.BRACKETS})"


def _plain_statements(log: DataFrame) -> DataFrame:
    """Every different statement once, as bare text.

    A log repeats its statements, so each text is read once. They are written out, for filters on what is found in a text would
    else be computed before the repeats are gone, and dealt to all tasks: a text costs more to read than to move.
    """
    quoted = F.regexp_replace("sql", r"""(?i)\b(FROM|JOIN|INTO|TABLE|OVERWRITE)(\s+)"([\w.$]+)\"""", "$1$2$3")
    # Operators and functions that hold a FROM of their own.
    text = F.regexp_replace(S.bare(quoted), r"(?i)\bIS\s+(?:NOT\s+)?DISTINCT\s+FROM\b", "=")
    text = F.regexp_replace(text, rf"(?i)\b(?:EXTRACT|TRIM|SUBSTRING|OVERLAY)\s*+(?={S.BRACKETS})\((?:[^()]++)\)", "f()")
    tasks = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(log.where("sql IS NOT NULL").select("sql").distinct().repartition(tasks).select(text.alias("sql")), "statements")


def _bare(c: Column) -> Column:
    """A table name without quotes, brackets or a closing mark around it."""
    return F.btrim(S.plain_name(c), F.lit('`";(),'))


def _target(text: Column) -> Column:
    """The first target of a statement as (dst, rel), null without one."""
    found = [(label, _bare(F.regexp_extract(text, pattern, 1))) for label, pattern in TARGET_PATTERNS]
    return F.coalesce(*[F.when(name != "", F.struct(name.alias("dst"), F.lit(label).alias("rel"))) for label, name in found])


def _tables(clause: Column) -> Column:
    """The tables of a FROM clause as (name, alias): names, or bracketed queries as they stand; a missing alias is the name's last part."""

    def pair(item: Column) -> Column:
        name, alias = F.regexp_extract(item, _TABLE_ITEM, 1), F.regexp_extract(item, _TABLE_ITEM, 2)
        return F.struct(
            F.when(name.startswith("("), name).otherwise(S.plain_name(name)).alias("name"),
            F.lower(S.plain_name(F.when(alias != "", alias).otherwise(F.regexp_extract(name, r"([\w$]+)`?$", 1)))).alias("alias"),
        )

    return F.transform(F.regexp_extract_all(clause, F.lit(_TABLE_ITEM), F.lit(0)), pair)


def _all_tables(text: Column) -> Column:
    """Names of all tables that FROM clauses of a text name, at any depth."""
    clauses = F.regexp_extract_all(text, F.lit(_FROM), F.lit(1))
    named = F.flatten(F.transform(clauses, lambda c: F.transform(_tables(c), lambda t: t["name"])))
    return F.filter(named, lambda n: ~n.startswith("(") & ~F.upper(n).isin(*NOT_A_TABLE))


def _defined(text: Column) -> Column:
    """Names, in lower case, that a statement defines by WITH."""
    none = F.array().cast("array<string>")
    names = F.transform(F.regexp_extract_all(text, F.lit(_CTE), F.lit(1)), lambda n: F.lower(S.plain_name(n)))
    return F.when(text.rlike(r"(?i)\bWITH\b"), names).otherwise(none)


def edges_from_log(log: DataFrame) -> DataFrame:
    """(src, dst, rel) table edges from (stmt_id, sql); each edge once.

    The first target of a statement counts. Sources are all tables of its FROM clauses, listed with commas or joined, at any
    depth. Names that the statement defines itself by WITH are not sources, nor is the target. Null texts have no edges.
    """
    text = F.col("sql")
    named = _plain_statements(log).select(_target(text).alias("target"), "sql").where("target IS NOT NULL")
    flat = named.select("target.dst", "target.rel", _defined(text).alias("local"), F.explode(F.array_distinct(_all_tables(text))).alias("src"))
    return flat.where(~F.array_contains("local", F.lower("src")) & (F.col("src") != F.col("dst"))).select("src", "dst", "rel").distinct()


def column_edges_from_log(log: DataFrame) -> DataFrame:
    """(src_table, src_column, dst_table, dst_column, transform) from (stmt_id, sql); each edge once.

    Read from the first SELECT list of a statement with a target (of UNION branches the first counts). Its items are cut at the commas
    outside brackets, and each writes one column: the one at its place in the list behind INSERT INTO, else its
    alias, else its last name. It reads the columns in it that are qualified by a table or an alias of the FROM clause; one without qualifier belongs to the first table of that clause. A
    bracketed query or a name defined by WITH stands for the first table that it reads, through other such names. ``transform`` is the function around the item as ``NAME()``, ``CASE``, or
    ``direct`` for a plain column and ``expression`` for the rest. Stars and literals name no column and give no edge.
    """
    text = F.col("sql")
    head = rf"(?is)^{S.until('SELECT')}SELECT\b(?:\s++(?:DISTINCT|ALL)\b)?+"
    select_list, from_clause = rf"{head}({S.until(_LIST_ENDS)})", rf"{head}{S.until(_LIST_ENDS)}FROM\b\s*+({S.until(_CLAUSES)})"
    into = r"(?is)\bINSERT\s+(?:INTO|OVERWRITE)\s+(?:TABLE\s+)?[^\s(]+\s*\(([^()]*)\)\s*(?:WITH|SELECT|\()"
    first = lambda body: F.get(_all_tables(body), F.lit(0))
    parsed = _plain_statements(log).select(
        _target(text).alias("target"),
        S.parts(F.regexp_extract(text, select_list, 1)).alias("items"),
        _tables(F.regexp_extract(text, from_clause, 1)).alias("tables"),
        F.transform(S.parts(F.regexp_extract(text, into, 1)), lambda c: F.lower(S.plain_name(c))).alias("listed"),
        _defined(text).alias("local"),
        F.when(text.rlike(r"(?i)\bWITH\b"), F.transform(F.regexp_extract_all(text, F.lit(_CTE), F.lit(2)), first)).otherwise(F.array().cast("array<string>")).alias("stands_for"),
    )
    # A name defined by WITH may read another one: as many steps as there are names.
    behind = lambda name: F.coalesce(F.get("stands_for", F.array_position("local", F.lower(name)).cast("int") - 1), name)
    real = lambda name: F.aggregate("local", F.when(name.startswith("("), first(name)).otherwise(name), lambda found, _: F.when(F.array_contains("local", F.lower(found)), behind(found)).otherwise(found))
    placed = parsed.where("target IS NOT NULL").select(
        "target.dst", "items", "listed", F.transform("tables", lambda t: F.struct(real(t["name"]).alias("name"), t["alias"].alias("alias"))).alias("tables"), "local"
    )
    items = placed.select("dst", "listed", "tables", "local", F.posexplode("items").alias("place", "item"))
    word = r"(?:[\w$]++|`[^`]++`)"
    alias = F.regexp_extract("item", rf"(?is)(?:\bAS\s+|[\w$)'`\"]\s+)({word})\s*$", 1)
    alias = F.when(F.upper(alias).isin("END", "NULL", "TRUE", "FALSE"), "").otherwise(alias)
    body = F.when(alias != "", F.regexp_replace("item", rf"(?is)\s*(?:\bAS\s+)?{word}\s*$", "")).otherwise(F.col("item"))
    typed = F.regexp_replace("body", rf"(?is)\bAS\s+\w++(?:\s*{S.BRACKETS})?+(?=\s*\))|''|\"\"", " ")
    last = F.regexp_extract("body", rf"(?is)({word})\s*$", 1)
    found = items.withColumn("alias", alias).withColumn("body", F.trim(body)).withColumn("text", typed)
    plain = rf"(?is)^{word}(?:\s*\.\s*{word})*$"
    written = F.coalesce(F.when(F.size("listed") > 0, F.get("listed", F.col("place"))), F.lower(S.plain_name(F.when(F.col("alias") != "", F.col("alias")).otherwise(F.when(F.col("body").rlike(plain), last)))))
    around = F.upper(F.regexp_extract("body", rf"(?is)^(\w++)\s*+{S.BRACKETS}(?:\s*+(?:OVER|FILTER)\b.*)?$", 1))
    kind = F.when(F.col("body").rlike(plain), "direct").when(F.col("body").rlike(r"(?i)^CASE\b"), "CASE").when(around != "", F.concat(around, F.lit("()"))).otherwise("expression")
    # Names that no bracket, name or dot follows are columns, with all that stands before their dots; a field of a struct would read the same.
    refs = F.regexp_extract_all("text", F.lit(rf"(?is)(?<![\w$.`])({word}(?:\s*+\.\s*+{word})*+)(?!\s*+[.(])"), F.lit(1))
    refs = F.filter(F.transform(refs, S.plain_name), lambda n: ~F.upper(n).isin(*_NO_COLUMN) & ~n.rlike(r"^\d"))
    read = found.select("dst", "tables", written.alias("dst_column"), kind.alias("transform"), F.explode(F.array_distinct(refs)).alias("ref"))
    # The column behind an alias, or behind the whole name of a table; what follows it are fields of a struct.
    steps = F.split(F.lower("ref"), r"\.")
    by_alias = F.transform(F.filter("tables", lambda t: t["alias"] == F.get("steps", F.lit(0))), lambda t: F.struct(t["name"].alias("name"), F.get("steps", F.lit(1)).alias("column")))
    ends = lambda t: F.size(F.split(t["name"], r"\."))
    by_name = F.transform(
        F.filter("tables", lambda t: F.lower("ref").startswith(F.concat(F.lower(t["name"]), F.lit(".")))), lambda t: F.struct(t["name"].alias("name"), F.get("steps", ends(t)).alias("column"))
    )
    alone = F.struct(F.get("tables", F.lit(0))["name"].alias("name"), F.get("steps", F.lit(0)).alias("column"))
    owner = F.when(F.size("steps") == 1, alone).otherwise(F.get(F.concat(by_alias, by_name), F.lit(0)))
    owned = read.withColumn("steps", steps).withColumn("owner", owner)
    edges = owned.select(F.col("owner.name").alias("src_table"), F.col("owner.column").alias("src_column"), F.col("dst").alias("dst_table"), "dst_column", "transform")
    good = edges.where("src_table IS NOT NULL AND dst_column IS NOT NULL AND dst_column <> '' AND src_table <> dst_table")
    return good.where(~F.upper("src_table").isin(*NOT_A_TABLE)).distinct()


def upstream(edges: DataFrame, table: str) -> DataFrame:
    return edges.where(F.col("dst") == table).select(F.col("src").alias("node")).distinct()


def downstream(edges: DataFrame, table: str) -> DataFrame:
    return edges.where(F.col("src") == table).select(F.col("dst").alias("node")).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """Tables nothing feeds; all sources when every one of them is fed."""
    sources = edges.select(F.col("src").alias("node")).distinct()
    first = sources.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    return sources if first.isEmpty() else first


def _bucket(node: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


class EdgeStore(NamedTuple):
    """Different edges as (near, far), written once in folders by a hash of ``near`` and sorted by it."""

    rows: DataFrame
    buckets: int

    def beside(self, buckets: Sequence[int]) -> DataFrame:
        """The edges whose near node falls in some buckets; only their folders are read."""
        return self.rows.where(F.col("bucket").isin(list(buckets)))


def store_edges(edges: DataFrame, direction: str = "downstream", buckets: int | None = None) -> EdgeStore:
    """Write the edges for tracing in one direction; as many buckets as shuffle partitions unless given.

    A node may have a large share of all edges: its bucket is dealt to ``SPREAD`` tasks by the far ends.
    """
    near, far = {"downstream": ("src", "dst"), "upstream": ("dst", "src")}[direction]
    spark = edges.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = edges.select(F.col(near).alias("near"), F.col(far).alias("far")).where("near IS NOT NULL AND far IS NOT NULL")
    rows = rows.withColumn("bucket", _bucket(F.col("near"), buckets)).withColumn("part", _bucket(F.col("far"), SPREAD))
    different = deal(rows, "bucket", "part").dropDuplicates(["bucket", "part", "near", "far"]).drop("part")
    path = scratch_path(spark, "edges")
    different.sortWithinPartitions("bucket", "near").write.partitionBy("bucket").parquet(path)
    return EdgeStore(spark.read.schema("near string, far string, bucket int").parquet(path), buckets)


def trace_many(
    edges: DataFrame | EdgeStore, origins: Sequence[str], direction: str = "downstream", max_depth: int | None = None, first: DataFrame | None = None
) -> DataFrame:
    """(origin, node, depth, path) of every table reachable from each origin, at its least depth, in one run for all of them.

    An origin is not part of its own answer. Of several shortest paths the smallest in order of names is given. Each hop
    reads the buckets of the edge store in which its frontier has nodes, joins it once and writes what is new. ``first`` replaces
    the edges of the first hop. Without ``max_depth`` the trace goes on until nothing new is reached. The written hops are one table, so
    the plan of a hop stays as small as that of the first however long the trace is.
    """
    store = edges if isinstance(edges, EdgeStore) else store_edges(edges, direction)
    spark = store.rows.sparkSession
    path = scratch_path(spark, "trace")
    kind = "origin string, node string, path array<string>, bucket int, depth int"
    names = sorted(set(origins))
    # Literals over a range, so Spark knows how few rows these are.
    start = spark.range(len(names)).select(F.get(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"), F.col("id").cast("int")).alias("origin"))
    start = start.select("origin", F.col("origin").alias("node"), F.array("origin").alias("path"), _bucket(F.col("origin"), store.buckets).alias("bucket"))
    start.write.parquet(f"{path}/depth=0")
    seen = lambda: spark.read.schema(kind).parquet(path)
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        frontier = spark.read.schema(kind).parquet(f"{path}/depth={depth - 1}")
        used = [r["bucket"] for r in frontier.select("bucket").distinct().collect()]
        if not used:
            break
        if depth == 1 and first is not None:
            steps = first.select(*(F.col(c).alias(a) for c, a in zip(("src", "dst") if direction == "downstream" else ("dst", "src"), ("near", "far"))))
        else:
            steps = store.beside(used).select("near", "far")
        hop = frontier.select("origin", "node", "path").join(steps, F.col("node") == F.col("near"))
        reached = hop.groupBy("origin", F.col("far").alias("node")).agg(F.min(F.array_append("path", F.col("far"))).alias("path"))
        new = reached.join(seen().select("origin", "node"), ["origin", "node"], "left_anti")
        new.select("origin", "node", "path", _bucket(F.col("node"), store.buckets).alias("bucket")).write.parquet(f"{path}/depth={depth}")
    return seen().where("depth > 0").select("origin", "node", "depth", "path")


def trace(
    edges: DataFrame | EdgeStore, origin: str, direction: str = "downstream", max_depth: int | None = None, first: DataFrame | None = None
) -> DataFrame:
    """Every table reachable from ``origin``: (node, depth, path), as ``trace_many`` gives it."""
    return trace_many(edges, [origin], direction, max_depth, first).select("node", "depth", "path")


def trace_from_column(
    column_edges: DataFrame, table_edges: DataFrame, table: str, column: str, direction: str = "downstream", max_depth: int | None = None
) -> DataFrame:
    """Trace that leaves ``table`` only through the edges of one column, then follows table edges.

    Column edges are (src_table, src_column, dst_table, dst_column, transform).
    """
    end = "src" if direction == "downstream" else "dst"
    mine = column_edges.where((F.col(f"{end}_table") == table) & (F.col(f"{end}_column") == column))
    first = mine.select(F.col("src_table").alias("src"), F.col("dst_table").alias("dst"))
    return trace(table_edges, table, direction, max_depth, first)


def trace_columns(column_edges: DataFrame, table: str, column: str, direction: str = "downstream", max_depth: int | None = None) -> DataFrame:
    """Trace at column level all the way; nodes are ``table.column``."""
    edges = column_edges.select(
        F.concat_ws(".", "src_table", "src_column").alias("src"), F.concat_ws(".", "dst_table", "dst_column").alias("dst")
    )
    return trace(edges, f"{table}.{column}", direction, max_depth)


def impact(edges: DataFrame, column_edges: DataFrame, table: str, max_depth: int | None = None) -> DataFrame:
    """One row on what a change of ``table`` reaches: tables, greatest depth, direct and indirect counts, direct columns."""
    reached = trace(edges, table, "downstream", max_depth).select("depth", F.lit(0).alias("column"))
    columns = affected_columns(column_edges, table).select(F.lit(None).cast("int").alias("depth"), F.lit(1).alias("column"))
    return reached.unionByName(columns).agg(
        F.lit(table).alias("source_table"),
        F.count("depth").alias("total_affected"),
        F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("impact_depth"),
        F.count_if(F.col("depth") == 1).alias("direct"),
        F.count_if(F.col("depth") > 1).alias("indirect"),
        F.coalesce(F.sum("column"), F.lit(0)).alias("affected_columns"),
    )


def affected_columns(column_edges: DataFrame, table: str) -> DataFrame:
    """Columns fed directly by ``table``."""
    return column_edges.where(F.col("src_table") == table).select(
        F.col("src_column").alias("source_column"),
        F.col("dst_table").alias("affected_table"),
        F.col("dst_column").alias("affected_column"),
        F.col("transform").alias("transformation"),
    )


def by_reach(traced: DataFrame) -> DataFrame:
    """Label traced tables ``direct`` or ``indirect``."""
    return traced.withColumn("reach", F.when(F.col("depth") == 1, "direct").otherwise("indirect"))


def upsert_edges(existing: DataFrame, new: DataFrame, order_column: str) -> DataFrame:
    """Fold new edges into the stored ones; the last transformation of an edge stays.

    Works for table edges and column edges alike: the key is every column but the order and
    ``transform`` / ``rel``.
    """
    keys = [c for c in existing.columns if c not in (order_column, "transform", "rel")]
    return upsert(existing, new, keys, order_column)


def _trim_loose_ends(edges: DataFrame, rounds: int = 1) -> DataFrame:
    """Drop edges whose start nothing enters or whose end nothing leaves, a few times over; what stays costs work later on but adds no cycle."""
    for _ in range(rounds):
        entered = edges.select(F.col("dst").alias("src")).distinct()
        left = edges.select(F.col("src").alias("dst")).distinct()
        edges = edges.join(entered, "src", "left_semi").join(left, "dst", "left_semi").select("src", "dst")
    return edges


def cycle_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that lies on a cycle: those of one component reach each other; it has the name of the smallest.

    Strongly connected components by colours: every node takes the largest mark (a hash, then the name) among the nodes that reach it, along edges until
    nothing changes. What reaches the node that gave a colour, backwards within the colour, is its component; the rest goes on
    without it. Rounds grow with the longest way in the graph, not with the number of cycles, and every round is written out. A
    node with an edge to itself is on a cycle. Null ends are no nodes.
    """
    pairs = edges.select(F.col("src").cast("string"), F.col("dst").cast("string")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    pairs = materialize(pairs, "cycle-edges")
    done = [pairs.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))]
    left = materialize(_trim_loose_ends(pairs.where("src <> dst")), "cycle-edges")
    mark = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("node"))
    while not left.isEmpty():
        colour = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", mark("node").alias("colour"))
        while True:
            # Two steps along the edges at a time.
            now = colour
            for _ in range(2):
                sent = now.join(left, now["node"] == left["src"]).select(F.col("dst").alias("node"), "colour")
                now = now.unionByName(sent).groupBy("node").agg(F.max("colour").alias("colour"))
            before = colour.withColumnRenamed("colour", "before")
            now = materialize(now.join(before, "node").select("node", "colour", (F.col("colour") != F.col("before")).alias("changed")), "colours")
            colour = now.select("node", "colour")
            if now.where("changed").isEmpty():
                break
        ends = lambda c: colour.select(F.col("node").alias(c), F.col("colour.node").alias(f"{c}_colour"))
        inside = left.join(ends("src"), "src").join(ends("dst"), "dst").where("src_colour = dst_colour")
        inside = materialize(inside.select("src", "dst", F.col("src_colour").alias("colour")), "cycle-edges")
        path = scratch_path(edges.sparkSession, "component")
        kind = "node string, colour string, hop int"
        found = lambda: edges.sparkSession.read.schema(kind).parquet(path)
        colour.where("node = colour.node").select("node", F.col("colour.node").alias("colour")).write.parquet(f"{path}/hop=0")
        for hop in count(1):
            last = found().where(F.col("hop") == hop - 1).select(F.col("node").alias("dst"), "colour")
            back = inside.join(last, ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            back.join(found().select("node"), "node", "left_anti").write.parquet(f"{path}/hop={hop}")
            if found().where(F.col("hop") == hop).isEmpty():
                break
        sizes = found().groupBy("colour").agg(F.count("*").alias("n"), F.min("node").alias("component")).where("n > 1")
        done.append(found().join(sizes, "colour").select("node", "component"))
        gone = found().select("node")
        rest = inside.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left = materialize(_trim_loose_ends(rest.select("src", "dst")), "cycle-edges")
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.groupBy("node").agg(F.min("component").alias("component"))


def cycles(edges: DataFrame, max_len: int | None = None, components: DataFrame | None = None) -> DataFrame:
    """All simple cycles, or those of up to ``max_len`` edges: (path, length), closed at both ends.

    Only for graphs whose cycles are few; ``cycle_components`` names the nodes on cycles of any graph, and given as ``components``
    it keeps all paths within one of them. A cycle is grown from its smallest node through greater nodes only, so it is
    found once. A self edge is the cycle [a, a].
    """
    steps = edges.select("src", "dst").distinct()
    if components is None:
        steps = materialize(_trim_loose_ends(materialize(steps, "cycle-edges")), "cycle-edges")
    else:
        a, b = (components.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component")) for c in ("src", "dst"))
        steps = materialize(steps.join(a, "src").join(b, "dst").where("src_component = dst_component").select("src", "dst"), "cycle-edges")
    self_loops = steps.where(F.col("src") == F.col("dst")).select(F.array("src", "dst").alias("path"), F.lit(1).alias("length"))
    onward = steps.where(F.col("src") != F.col("dst"))
    paths = onward.where(F.col("dst") > F.col("src")).select(F.array("src", "dst").alias("path"))
    result = self_loops
    for length in count(2) if max_len is None else range(2, max_len + 1):
        last, first = F.element_at("path", -1), F.element_at("path", 1)
        step = paths.join(onward, last == onward["src"]).where(
            (F.col("dst") >= first) & ((F.col("dst") == first) | ~F.array_contains("path", F.col("dst")))
        )
        grown = materialize(step.select(F.array_append("path", F.col("dst")).alias("path")), "cycle-paths")
        closed = F.element_at("path", -1) == F.element_at("path", 1)
        result = result.unionByName(grown.where(closed).withColumn("length", F.lit(length)))
        paths = grown.where(~closed)
        if paths.isEmpty():
            break
    return result


def flow_problems(
    edges: DataFrame, layers: DataFrame, transitions: Sequence[tuple[str, str]] = ALLOWED_TRANSITIONS
) -> DataFrame:
    """(table_name, upstream, problem) for a flow of (src, dst) edges and (table_name, layer).

    A target without a layer is reported once and not examined further. Otherwise its name is
    checked against its layer, and each source must have a layer that may feed the target's.
    """
    flow = materialize(deal(edges.select("src", "dst"), "src", "dst").distinct(), "flow")
    src_layer = layers.select(F.col("table_name").alias("src"), F.col("layer").alias("src_layer"))
    dst_layer = layers.select(F.col("table_name").alias("dst"), F.col("layer").alias("dst_layer"))
    placed = flow.join(src_layer, "src", "left").join(dst_layer, "dst", "left")
    allowed = F.lit(False)
    for a, b in transitions:
        allowed = allowed | ((F.col("src_layer") == a) & (F.col("dst_layer") == b))
    problem = (
        F.when(F.col("dst_layer").isNull(), F.lit(None))
        .when(F.col("src_layer").isNull(), "upstream_without_layer")
        .when(~allowed, "forbidden_transition")
    )
    links = placed.select(F.col("dst").alias("table_name"), F.col("src").alias("upstream"), problem.alias("problem"))
    targets = flow.select(F.col("dst").alias("table_name")).distinct().join(layers.select("table_name", "layer"), "table_name", "left")
    nothing = F.lit("").alias("upstream")
    homeless = targets.where("layer IS NULL").select("table_name", nothing, F.lit("table_without_layer").alias("problem"))
    names = placement_problems(targets.where("layer IS NOT NULL")).select("table_name", nothing, F.col("rule").alias("problem"))
    return links.where("problem IS NOT NULL").unionByName(homeless).unionByName(names)
