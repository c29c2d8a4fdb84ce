"""Algorithms of arrangement by name: one call for built-in and registered ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import kernels as K
from ..operators import arrangements, packing
from .runner import per_graph

Algorithm = Callable[..., DataFrame]
_ALGORITHMS: dict[str, Algorithm] = {}


def register(name: str, algorithm: Algorithm) -> Callable[[], None]:
    """Add or replace an algorithm (nodes, edges, **options) -> placed nodes.  The result undoes just this step."""
    before = _ALGORITHMS.get(name)
    _ALGORITHMS[name] = algorithm

    def undo() -> None:
        if _ALGORITHMS.get(name) is not algorithm:
            return
        if before is None:
            del _ALGORITHMS[name]
        else:
            _ALGORITHMS[name] = before

    return undo


def algorithms() -> list[str]:
    return sorted(_ALGORITHMS)


def invalid_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, id, problem): repeated node ids, edges without their nodes, sizes below zero or no numbers."""
    twice = nodes.groupBy("graph_id", F.col("node_id").alias("id")).count().where("count > 1").select("graph_id", "id", F.lit("repeated node").alias("problem"))
    size = nodes.where("not (width >= 0 and height >= 0) or isnan(width) or isnan(height)").select("graph_id", F.col("node_id").alias("id"), F.lit("bad size").alias("problem"))
    loose = G.dangling(nodes, edges).select("graph_id", F.col("edge_id").alias("id"), F.lit("missing endpoint").alias("problem"))
    return twice.unionByName(size).unionByName(loose)


def arrange(nodes: DataFrame, edges: DataFrame, algorithm: str | Algorithm = "layered", **options) -> DataFrame:
    """Placed nodes of every graph by an algorithm, named or given as a function."""
    if callable(algorithm):
        return algorithm(nodes, edges, **options)
    if algorithm not in _ALGORITHMS:
        raise ValueError(f"no algorithm {algorithm!r}; there are {', '.join(algorithms())}")
    return _ALGORITHMS[algorithm](nodes, edges, **options)


def _longest_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return per_graph(nodes, edges, lambda ids, _, es: zip(ids, K.longest_path(len(ids), es), strict=True), "node_id string, layer int")


def layered(
    nodes: DataFrame,
    edges: DataFrame,
    *,
    break_cycles: Callable[[DataFrame, DataFrame], DataFrame] = G.model_order_orientation,
    assign_layers: Callable[[DataFrame, DataFrame], DataFrame] = _longest_path,
    order_nodes: Callable[[DataFrame, DataFrame], DataFrame] = G.order_in_layers,
    place_nodes: Callable[..., DataFrame] = G.place_simple,
    trace: Callable[[str, DataFrame], None] | None = None,
    **options,
) -> DataFrame:
    """Layers in flow direction.  Every phase can be another function of (nodes, edges), (nodes, edges in flow
    direction), (nodes, layers) and (nodes, order, **options); ``trace`` is told each phase's name and rows."""
    told = trace or (lambda name, rows: None)
    orientation = break_cycles(nodes, edges)
    told("break_cycles", orientation)
    layers = assign_layers(nodes, G.oriented(edges, orientation))
    told("assign_layers", layers)
    order = order_nodes(nodes, layers)
    told("order_nodes", order)
    placed = place_nodes(nodes, order, **options)
    told("place_nodes", placed)
    return placed


def _points(kernel) -> Algorithm:
    def run(nodes: DataFrame, edges: DataFrame, **options) -> DataFrame:
        def rows(ids, _, es):
            yield from ((a, float(p[0]), float(p[1])) for a, p in zip(ids, kernel(len(ids), es, **options), strict=True))

        return per_graph(nodes, edges, rows, "node_id string, x double, y double")

    return run


register("layered", layered)
register("force", _points(arrangements.force_arrangement))
register("stress", _points(lambda n, es, **o: K.stress_arrangement(n, es, **o)[0]))
register("rectpacking", lambda nodes, edges, **o: packing.rectangle_packing(nodes, **o))
register("box", lambda nodes, edges, **o: packing.box_packing(nodes, **o))
register("fixed", lambda nodes, edges, **o: packing.normalised(nodes, **o))
register("sporeCompaction", lambda nodes, edges, **o: packing.relative_spread(nodes, True, **o))
register("sporeOverlap", lambda nodes, edges, **o: packing.relative_spread(nodes, False, **o))
register("tree", lambda nodes, edges, **o: arrangements.tree_arrangement(nodes, **o))
register("radial", lambda nodes, edges, **o: arrangements.radial_arrangement(nodes, **o))
