"""Faults that the third review found, each with rows of its own."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lakestrata.operators import governance as G
from lakestrata.operators import lineage as L
from lakestrata.sources import extract as X
from lakestrata.sources import write as W


def schema_columns(spark, schemas):
    return spark.createDataFrame([(t, c, k) for t, cs in schemas.items() for c, k in cs.items()], "table_name string, column_name string, data_type string")


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_similar_schemas_of_all_widths(spark, threshold):
    rng = random.Random(11)
    pool = [f"c{i}" for i in range(40)]
    # Widths on both sides of the limit of two-name keys, and equal names with other types.
    schemas = {f"t{i:03d}": dict.fromkeys(rng.sample(pool, rng.choice([1, 2, 3, 22, 24, 25, 30])), rng.choice(["INT", "STRING"])) for i in range(120)}
    found = G.similar_schemas(schema_columns(spark, schemas), threshold)
    got = [(r["table_a"], r["table_b"], r["n_common"]) for r in found.collect()]
    first = {}
    for t, cs in sorted(schemas.items()):
        first.setdefault(tuple(sorted(cs.items())), t)
    kept = sorted(first.values())
    pairs = [(a, b, len(schemas[a].keys() & schemas[b].keys()), len(schemas[a].keys() | schemas[b].keys())) for a, b in itertools.combinations(kept, 2)]
    assert sorted(got) == [(a, b, n) for a, b, n, u in pairs if n / u >= threshold]


def test_narrow_schemas_meet_at_two_names(spark):
    """tables of a few of many names, all equally frequent, were compared with all that share one name."""
    rng = random.Random(5)
    schemas = [(f"t{i:04d}", sorted(rng.sample(range(100), rng.randint(3, 6)))) for i in range(2000)]
    ranked = spark.createDataFrame(schemas, "group_table string, names array<long>").withColumn("n", F.size("names"))
    met = lambda keys, *by: keys.groupBy(*by).count().agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0]
    one, two = met(G.schema_keys(ranked, 0.5), "name"), met(G.schema_pair_keys(ranked, 0.5), "first", "name")
    assert 8 * two < one


def test_csv_files_are_of_bounded_size(spark, tmp_path):
    """four files whatever the size, and each is read by one task."""
    texts = [(i, "a\n\"b " * 200 + str(i)) for i in range(400)]
    df = spark.createDataFrame([*texts, (400, None), (None, "")], "id long, text string")
    path = tmp_path / "out"
    W.export_csv(df, str(path), file_bytes=20_000)
    sizes = [f.stat().st_size for f in path.glob("*.csv")]
    assert len(sizes) >= 20 and max(sizes) < 60_000
    assert sorted(map(tuple, X.read_csv(spark, str(path), df.schema).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_edges_are_deduplicated_in_parts_that_stay_apart(spark):
    """parts that adaptive execution joined held all edges of a compressed size in one aggregate."""
    from lakestrata.session import deal

    edges = spark.range(3000).selectExpr("concat('a', id % 50) AS src", "concat('b', id % 40) AS dst")
    dealt = deal(edges, "src", "dst").distinct()
    assert dealt.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    store = L.store_edges(edges)
    assert store.rows.count() == store.rows.distinct().count() == edges.distinct().count()
    layers = spark.createDataFrame([("a1", "ODS"), ("b1", "DWD")], "table_name string, layer string")
    found = L.flow_problems(edges, layers)
    assert found.count() == found.distinct().count() and found.where("problem = 'table_without_layer'").count() == 39


def test_pairs_bring_their_schemas(spark):
    """pairs were joined with the names of both sides; now they come with them, and the verdicts are the same."""
    from lakestrata.operators import similarity as S

    rng = random.Random(2)
    vectors = [(i, [rng.choice([-1.0, 0.5, 1.0]) for _ in range(3)]) for i in range(90)]
    schemas = {i: {f"c{k}": "INT" if x > 0 else "STRING" for k, x in enumerate(v) if x != 0.5} for i, v in vectors}
    columns = spark.createDataFrame([(i, c, k) for i, cs in schemas.items() for c, k in cs.items()], "table_name long, column_name string, data_type string")
    df = spark.createDataFrame(vectors, "id long, v array<double>")
    apart, _ = S.similar_classes(df, "id", "v", 0.6, block_rows=7, pivots=3)
    judged = G.final_verdict(apart, G.compare_tables(columns, apart.select("table_a", "table_b")))
    held = df.join(G.pack_schemas(columns).withColumnRenamed("table_name", "id"), "id", "left")
    pairs, _ = S.similar_classes(held, "id", "v", 0.6, block_rows=7, pivots=3, carry=["names", "typed"])
    together = G.final_verdict(G.compare_tables(None, pairs.withColumnRenamed("similarity", "vector_similarity")))
    names = ["table_a", "table_b", "vector_similarity", "name_similarity", "type_share", "verdict"]
    assert sorted(map(tuple, judged.select(names).collect())) == sorted(map(tuple, together.select(names).collect()))
    assert judged.count() > 50
    assert "Join" not in together._jdf.queryExecution().optimizedPlan().toString()


def test_missing_column_names(spark):
    schemas = {"a": [None, "x", "y"], "b": [None, "x", "z"], "c": ["x"], "d": ["x", "y", "z", "w"], "e": [None, "q"]}
    cols = spark.createDataFrame([(t, c, "INT") for t, cs in schemas.items() for c in cs], "table_name string, column_name string, data_type string")
    got = {(r["table_a"], r["table_b"]) for r in G.similar_schemas(cols, 0.5).collect()}
    assert ("a", "e") not in got and ("b", "e") not in got
