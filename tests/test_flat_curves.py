"""Curves as rows: the points of ``flattened``, and nodes that their chords run through, against all chords."""

import random

from pyspark.sql import functions as F

from strata.functions import curves
from strata.operators import quality

CUBIC = "struct<" + ",".join(f"{p}:struct<x:double,y:double>" for p in ("a", "c1", "c2", "b")) + ">"


def test_rows_are_the_points_and_find_the_hits(spark):
    rnd = random.Random(8)
    at = lambda far: (rnd.uniform(-far, far), rnd.uniform(-far, far))
    ends = [(f"n{i % 30}", f"n{(i * 7 + 3) % 30}") for i in range(60)]
    rows = [(str(i % 2), f"e{i}", *ends[i], [at(far) for _ in range(4)]) for i, far in enumerate([5.0, 300.0, 6000.0] * 20)]
    rows.append(("0", "point", "n0", "n1", [(1.0, 1.0)] * 4))
    cubics = spark.createDataFrame([(*r[:4], tuple(r[4])) for r in rows], f"graph_id string, edge_id string, source_id string, target_id string, c {CUBIC}")
    nodes = spark.createDataFrame([(g, f"n{i}", *at(1000), rnd.uniform(1, 400), rnd.uniform(1, 400)) for g in "01" for i in range(30)], "graph_id string, node_id string, x double, y double, width double, height double")
    arrays = cubics.select("*", curves.flattened(F.col("c")).alias("points"))
    want = {(r.edge_id, r.k): (r.p.x, r.p.y) for r in arrays.select("edge_id", F.posexplode("points").alias("k", "p")).collect()}
    assert {(r.edge_id, r.k): (r.x, r.y) for r in curves.flat_points(cubics).collect()} == want
    assert max(k for _, k in want) > 3 * 16  # several pieces
    hits = quality.line_hits(arrays, nodes).join(cubics, ["graph_id", "edge_id"]).where("node_id <> source_id and node_id <> target_id")
    expected = {(r.graph_id, r.edge_id, r.node_id) for r in hits.collect()}
    got = [tuple(r) for r in quality.curve_hits(cubics, nodes).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(got) > 50
