"""Runs a per-graph kernel: nodes and edges of a graph meet in one row, rows go to Python in Arrow batches.

One shuffle by ``graph_id`` brings nodes and edges together; graphs are independent, so many small graphs spread over
all tasks.  One graph must fit a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("ord", "node_id"))).alias("ns"))
    e = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("ord", "edge_id", "source_id", "target_id", "weight"))).alias("es"))
    return n.join(e, "graph_id", "left")


def per_graph(nodes: DataFrame, edges: DataFrame, kernel: Callable[[list[str], list[str], list[tuple[int, int, int]]], Iterable[tuple]], schema: str) -> DataFrame:
    """``kernel(node ids, edge ids, edges)`` -> rows without graph_id; ``schema`` describes them.  Edges with an
    endpoint that is no node are left out (``dangling`` reports them)."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for gid, ns, es in zip(batch["graph_id"], batch["ns"], batch["es"], strict=True):
                ids = [x["node_id"] for x in ns]
                number = {a: i for i, a in enumerate(ids)}
                es = [] if es is None else [x for x in es if x["source_id"] in number and x["target_id"] in number]
                rows += [(gid, *r) for r in kernel(ids, [x["edge_id"] for x in es], [(number[x["source_id"]], number[x["target_id"]], int(x["weight"])) for x in es])]
            yield pd.DataFrame(rows, columns=["graph_id", *names])

    return packed(nodes, edges).mapInPandas(run, f"graph_id string, {schema}")
