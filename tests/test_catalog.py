"""Every query with SQL gives the rows that DuckDB gives, over whole tables of the smallest scale."""

import duckdb
import pandas as pd
import pytest

from strata.plans import catalog, catalog_curves, catalog_drawings, catalog_more, catalog_routes, catalog_visibility  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(df):
    one = lambda v: None if pd.isna(v) else str(v) if isinstance(v, (str, bool)) else float(v)
    return sorted((tuple(map(one, r)) for r in df[sorted(df.columns)].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_lcg_is_javas(spark):
    from pyspark.sql import functions as F

    from strata.operators.packing import lcg_doubles

    assert spark.range(1).select(lcg_doubles(2, F.lit(42).cast("long")).alias("d")).first().d == [0.7275636800328681, 0.6832234717598454]


def test_graph_json(spark, tmp_path):
    from strata.sources.graphs import read_graph_json

    (tmp_path / "g.json").write_text('{"id":"g","children":[{"id":"a","width":4,"height":2,"children":[{"id":"b","x":1}]}],"edges":[{"id":"e","sources":["a"],"targets":["b"]}]}')
    nodes, edges = read_graph_json(spark, str(tmp_path), 3)
    assert sorted((r.node_id, r.parent_id, r.x, r.width) for r in nodes.collect()) == [("a", None, 0.0, 4.0), ("b", "a", 1.0, 0.0)]
    assert [(r.edge_id, r.source_id, r.target_id) for r in edges.collect()] == [("e", "a", "b")]


def test_merge_and_apply(spark):
    from strata.operators import patches

    d = spark.createDataFrame([("g", "a", 1, "add", 1), ("g", "a", 2, "update", 2), ("g", "b", 1, "add", 1), ("g", "b", 2, "remove", None), ("g", "c", 1, "remove", None), ("g", "c", 2, "add", 7), ("g", "d", 1, "update", 1), ("g", "d", 2, "add", 3)], "graph_id string, id string, seq int, op string, value int")
    net = patches.merge_diffs(d)
    assert sorted((r.id, r.op, r.value) for r in net.collect()) == [("a", "add", 2), ("c", "update", 7), ("d", "conflict", None)]
    state = spark.createDataFrame([("g", "c", 5), ("g", "z", 9)], "graph_id string, id string, value int")
    assert sorted((r.id, r.value) for r in patches.apply_changes(state, net.where("op <> 'conflict'")).collect()) == [("a", 2), ("c", 7), ("z", 9)]
