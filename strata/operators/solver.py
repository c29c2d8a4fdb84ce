"""Constraints of four strengths solved together: places that break the stronger ones least, before all weaker ones.

A constraint is a row: terms (node, attribute, factor) whose sum is equal to, or not below, a constant.  Builders make
rows of pins, alignments and even gaps.  A graph's rows are one linear program, whose costs are compared strength by
strength, as a whole: required first, then strong, medium, weak, and last that nodes stay where they are.  Only nodes that
constraints name are in it.  A graph is one group of a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRENGTHS = ("required", "strong", "medium", "weak")
ATTRIBUTES = ("x", "y", "right", "bottom", "centerX", "centerY")
ROWS = "graph_id string, constraint_id string, strength string, relation string, constant double, terms array<struct<node_id:string,attribute:string,factor:double>>"
_EPS = 1e-9


def least(levels: int, rows: list[tuple[dict[int, float], str, float, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values of n free variables, what each row misses by): rows are (factors, "=" or ">=", constant, level).

    Misses are least in sum on the first level, then on the second, and so on.  Simplex with Bland's rule, so it ends.
    """
    m = len(rows)
    table, costs, basis = np.zeros((m, 2 * n + 2 * m + 1)), np.zeros((levels, 2 * n + 2 * m + 1)), []
    for i, (factors, relation, constant, level) in enumerate(rows):
        for j, f in factors.items():
            table[i, 2 * j] += f
            table[i, 2 * j + 1] -= f
        below, above = 2 * n + 2 * i, 2 * n + 2 * i + 1
        table[i, below], table[i, above], table[i, -1] = 1, -1, constant
        costs[level, below] = 1
        costs[level, above] = relation == "="
        if constant < 0:
            table[i] *= -1
        basis.append(above if constant < 0 else below)
    reduced = costs.copy()
    for i, b in enumerate(basis):
        reduced -= np.outer(costs[:, b], table[i])
    while True:
        signs = np.where(np.abs(reduced[:, :-1]) > _EPS, np.sign(reduced[:, :-1]), 0)
        first = (signs != 0).argmax(0)
        worse = np.flatnonzero(signs[first, np.arange(signs.shape[1])] < 0)
        if not len(worse):
            break
        column = worse[0]
        able = np.flatnonzero(table[:, column] > _EPS)
        ratios = table[able, -1] / table[able, column]
        row = min((i for i, q in zip(able, ratios, strict=True) if q <= ratios.min() + _EPS), key=basis.__getitem__)
        table[row] /= table[row, column]
        for i in range(m):
            if i != row and table[i, column]:
                table[i] -= table[i, column] * table[row]
        reduced -= np.outer(reduced[:, column], table[row])
        basis[row] = column
    values = np.zeros(2 * n + 2 * m)
    values[basis] = table[:, -1]
    misses = values[2 * n :: 2] + np.array([r[1] == "=" for r in rows]) * values[2 * n + 1 :: 2]
    return values[0 : 2 * n : 2] - values[1 : 2 * n : 2], misses


def pinned(pins: DataFrame, attribute: str = "x", strength: str = "required") -> DataFrame:
    """Rows that hold an attribute of a node (graph_id, node_id, at) at a place."""
    term = F.array(F.struct(F.col("node_id"), F.lit(attribute).alias("attribute"), F.lit(1.0).alias("factor")))
    return pins.select("graph_id", F.concat(F.lit(f"pin:{attribute}:{strength}:"), "node_id").alias("constraint_id"), F.lit(strength).alias("strength"), F.lit("=").alias("relation"), F.col("at").cast("double").alias("constant"), term.alias("terms"))


def _pairs(groups: DataFrame, to: Column) -> DataFrame:
    """Members of a group (graph_id, group_id, node_id, k) with the one that ``to`` tells."""
    return groups.withColumn("other_id", to).where("other_id is not null and other_id <> node_id")


def aligned(groups: DataFrame, attribute: str = "centerX", strength: str = "required") -> DataFrame:
    """Rows that give the members of a group (graph_id, group_id, node_id, k) one value: that of its first."""
    by = Window.partitionBy("graph_id", "group_id").orderBy("k")
    rows = _pairs(groups, F.first("node_id").over(by))
    term = lambda c, f: F.struct(F.col(c).alias("node_id"), F.lit(attribute).alias("attribute"), F.lit(f).alias("factor"))
    return rows.select("graph_id", F.concat(F.lit(f"align:{attribute}:"), "group_id", F.lit(":"), "node_id").alias("constraint_id"), F.lit(strength).alias("strength"), F.lit("=").alias("relation"), F.lit(0.0).alias("constant"), F.array(term("node_id", 1.0), term("other_id", -1.0)).alias("terms"))


def distributed(groups: DataFrame, gap: float, axis: str = "y", strength: str = "required") -> DataFrame:
    """Rows that put the members of a group, in order of k, ``gap`` apart along ``axis``."""
    by = Window.partitionBy("graph_id", "group_id").orderBy("k")
    rows = _pairs(groups, F.lag("node_id").over(by))
    end = {"x": "right", "y": "bottom"}[axis]
    term = lambda c, a, f: F.struct(F.col(c).alias("node_id"), F.lit(a).alias("attribute"), F.lit(f).alias("factor"))
    return rows.select("graph_id", F.concat(F.lit(f"gap:{axis}:"), "group_id", F.lit(":"), "node_id").alias("constraint_id"), F.lit(strength).alias("strength"), F.lit("=").alias("relation"), F.lit(float(gap)).alias("constant"), F.array(term("node_id", axis, 1.0), term("other_id", end, -1.0)).alias("terms"))


def solved(nodes: DataFrame, constraints: DataFrame) -> DataFrame:
    """(graph_id, kind, id, x, y, missed, status): a row of kind ``node`` for each node that a constraint names, and one of kind
    ``constraint`` for each constraint with what it misses by.

    status: ``ok``; ``violated`` where a constraint can't be met for stronger ones; ``unsatisfied`` for a
    required one that others contradict; ``unknown`` for one that names a node that isn't there (it takes no part).
    """
    size = {"x": 0.0, "y": 0.0, "right": 1.0, "bottom": 1.0, "centerX": 0.5, "centerY": 0.5}
    schema = "graph_id string, kind string, id string, x double, y double, missed double, status string"

    def kernel(key: tuple, node: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        boxes = {r.node_id: r for r in node.itertuples(index=False)}
        rows = rows.sort_values("constraint_id")
        named = [all(t["node_id"] in boxes for t in terms) for terms in rows["terms"]]
        used = sorted({t["node_id"] for terms, ok in zip(rows["terms"], named, strict=True) if ok for t in terms})
        number = {n: 2 * i for i, n in enumerate(used)}
        # variables are moves from where a node is
        given = []
        for r, ok in zip(rows.itertuples(index=False), named, strict=True):
            if not ok:
                continue
            factors: dict[int, float] = {}
            constant = r.constant
            for t in r.terms:
                b, along_y = boxes[t["node_id"]], t["attribute"] in ("y", "bottom", "centerY")
                j = number[t["node_id"]] + along_y
                factors[j] = factors.get(j, 0.0) + t["factor"]
                constant -= t["factor"] * ((b.y if along_y else b.x) + size[t["attribute"]] * (b.height if along_y else b.width))
            given.append((factors, r.relation, constant, STRENGTHS.index(r.strength)))
        stay = [({j: 1.0}, "=", 0.0, len(STRENGTHS)) for j in range(2 * len(used))]
        moves, misses = least(len(STRENGTHS) + 1, given + stay, 2 * len(used))
        out = [(key[0], "node", n, boxes[n].x + moves[j], boxes[n].y + moves[j + 1], None, "ok") for n, j in number.items()]
        missed = iter(misses)
        for r, ok in zip(rows.itertuples(index=False), named, strict=True):
            by = float(next(missed)) if ok else None
            status = "unknown" if not ok else "ok" if by <= 1e-6 else "unsatisfied" if r.strength == "required" else "violated"
            out.append((key[0], "constraint", r.constraint_id, None, None, by, status))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")]).astype({"x": float, "y": float, "missed": float})

    boxes = nodes.select("graph_id", "node_id", "x", "y", "width", "height")
    return boxes.groupBy("graph_id").cogroup(constraints.groupBy("graph_id")).applyInPandas(kernel, schema)
