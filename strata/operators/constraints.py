"""Constraints on places as rows (graph_id, group_id, node_id): aligned, evenly spread and pinned nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _size(axis: str) -> str:
    return {"x": "width", "y": "height"}[axis]


def _middle(axis: str) -> Column:
    return F.col(axis) + F.col(_size(axis)) / 2


def aligned(nodes: DataFrame, groups: DataFrame, pins: DataFrame, axis: str = "x") -> DataFrame:
    """Nodes of a group get one middle along ``axis``: that of its pinned node with the least id (graph_id, node_id,
    at), else the mean of theirs.  One row a node of a group: graph_id, node_id, the new place."""
    by = Window.partitionBy("graph_id", "group_id")
    n = groups.join(nodes, ["graph_id", "node_id"]).join(pins.select("graph_id", "node_id", F.col("at").alias("pin")), ["graph_id", "node_id"], "left")
    pin = F.min(F.when(F.col("pin").isNotNull(), F.struct("node_id", "pin"))).over(by)["pin"]
    return n.select("graph_id", "node_id", (F.coalesce(pin, F.avg(_middle(axis)).over(by)) - F.col(_size(axis)) / 2).alias(axis))


def distributed(nodes: DataFrame, groups: DataFrame, axis: str = "x") -> DataFrame:
    """The first and last node of a group stay; the gaps between all of its nodes become equal (they may be negative)."""
    by = Window.partitionBy("graph_id", "group_id")
    order = by.orderBy(axis, "node_id")
    size = _size(axis)
    n = groups.join(nodes, ["graph_id", "node_id"])
    first, last, end = F.min(F.struct(axis, "node_id")).over(by)[axis], F.max(F.struct(axis, "node_id", size)).over(by), F.count("*").over(by)
    gap = (last[axis] + last[size] - first - F.sum(size).over(by)) / (end - 1)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return n.select("graph_id", "node_id", F.when(end > 1, first + before + gap * (F.row_number().over(order) - 1)).otherwise(F.col(axis)).alias(axis))
